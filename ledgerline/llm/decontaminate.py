"""Benchmark decontamination by Wu-Manber search over words.

Patterns are the windows of the benchmark's items: every ``window``
consecutive words, or the whole item if it has fewer.  Texts and items are
lower-cased (A-Z) and cut into words; a word is one symbol of the search.
Per pattern length ``m`` there is a shift table over blocks of two words (of
one for one-word patterns): how far the search may jump when that block ends
at the current place; unseen blocks allow the whole ``m - 1``.  Where the
shift is 0, the block's bucket holds the patterns that end in it, and these
are compared word by word.

Style: Python inside Arrow batches; no shuffle of documents.  The benchmark
is sent to the tasks in blocks of items of at most ``block_bytes`` of text,
so that what is broadcast has a bound however long the benchmark is; each
block is one pass over all documents, and what earlier passes found is
written to the shared folder in between.

Defined results: null or empty texts and items have no words; an item without
words hits nothing; repeated items count once by id; a null item id hits words
and counts as one item, written as an empty string; repeated documents each
get a result; other columns are kept unless their names clash with added ones.
"""

from __future__ import annotations

from collections import defaultdict
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, stored, table

WINDOW = 10
#: A block's search tables take about 110 times its text in each worker.
BLOCK_BYTES = 1 << 20

#: Bytes of words stay (A-Z in lower case), all other ASCII bytes are gaps.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_BYTES).split() if text else []


def windows_of(words: list[bytes], window: int = WINDOW) -> list[tuple[bytes, ...]]:
    if len(words) <= window:
        return [tuple(words)] if words else []
    return [tuple(words[k:k + window]) for k in range(len(words) - window + 1)]


class Matcher:
    """Shift and bucket tables of the patterns of one length."""

    def __init__(self, size: int):
        self.size = size
        self.shift: dict = {}
        self.bucket: dict = defaultdict(dict)

    def add(self, pattern: tuple[bytes, ...], item: int) -> None:
        m = self.size
        if m == 1:
            self.bucket[pattern[0]].setdefault(pattern, set()).add(item)
            return
        for stop in range(1, m):
            block = pattern[stop - 1], pattern[stop]
            self.shift[block] = min(self.shift.get(block, m), m - 1 - stop)
        self.bucket[pattern[-2:]].setdefault(pattern, set()).add(item)

    def search(self, words: list[bytes]):
        """(from, to, items) of each occurrence."""
        m, n = self.size, len(words)
        if m == 1:
            for k, w in enumerate(words):
                if w in self.bucket:
                    yield k, k + 1, self.bucket[w][w,]
            return
        shift, most, at = self.shift.get, m - 1, m - 1
        while at < n:
            jump = shift((words[at - 1], words[at]), most)
            if jump:
                at += jump
                continue
            start = at - m + 1
            for pattern, items in self.bucket[words[at - 1], words[at]].items():
                if all(map(bytes.__eq__, pattern, words[start:at + 1])):
                    yield start, at + 1, items
            at += 1


def compile_patterns(items: list[tuple[object, str | None]], window: int = WINDOW) -> list[Matcher]:
    """Search tables for (id, text) items, by pattern length."""
    by_size: dict[int, Matcher] = {}
    for item, text in items:
        for pattern in windows_of(words_of(text), window):
            by_size.setdefault(len(pattern), Matcher(len(pattern))).add(pattern, item)
    return list(by_size.values())


def merge_ranges(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, stop in sorted(ranges):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return [(a, b) for a, b in out]


RANGES = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))


def find_windows(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW,
                 block_bytes: int = BLOCK_BYTES, keep_text: bool = True) -> DataFrame:
    """``docs`` plus ``n_words``, ``hits`` (merged word ranges inside
    occurrences) and ``items`` (sorted ids, as strings, of items found)."""
    spark = docs.sparkSession
    added = ("n_words", "hits", "items")
    out = docs.drop(*[c for c in added if c != text])
    names = [f.name for f in out.schema.fields if f.name not in added and f.name != text]
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields if f.name in names)
    lists = "n_words bigint, hits array<struct<from:int,to:int>>, items array<string>"

    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    total = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-total // block_bytes))
    for k in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k)
        tables = spark.sparkContext.broadcast([(r["item"], r["text"]) for r in part.collect()])
        last = k == blocks - 1
        keep = [text, *names] if keep_text or not last else names

        def run(batches, tables=tables, first=k == 0, keep=keep):
            matchers = compile_patterns(tables.value, window)
            for batch in batches:
                made = {"n_words": [], "hits": [], "items": []}
                for row, whole in enumerate(batch.column(text)):
                    words = words_of(whole.as_py())
                    ranges, found = [], set()
                    for matcher in matchers:
                        for start, stop, ids in matcher.search(words):
                            ranges.append((start, stop))
                            found |= ids
                    if not first:
                        ranges += [(h["from"], h["to"]) for h in batch.column("hits")[row].as_py()]
                        found |= set(batch.column("items")[row].as_py())
                    made["n_words"].append(len(words))
                    made["hits"].append([{"from": a, "to": b} for a, b in merge_ranges(ranges)])
                    made["items"].append(sorted(found))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in keep), pa.array(made["n_words"], pa.int64()),
                     pa.array(made["hits"], RANGES), pa.array(made["items"], pa.list_(pa.string()))],
                    names=[*keep, *added])

        schema = ", ".join(x for x in (f"`{text}` string" if text in keep else "", types, lists) if x)
        out = map_batches(out, run, schema)
        if not last:
            out = stored(out, "decontaminate")
    return out


def summarise(found: DataFrame) -> DataFrame:
    """Adds ``n_hit``, ``n_items``, ``items_sha256`` and ``contaminated``."""
    hit = F.aggregate("hits", F.lit(0).cast("bigint"), lambda n, h: n + h["to"] - h["from"])
    return (found.withColumn("n_hit", hit).withColumn("n_items", F.size("items").cast("bigint"))
            .withColumn("items_sha256", F.sha2(F.array_join("items", ","), 256))
            .withColumn("contaminated", F.col("n_hit") > 0))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_windows(table(spark, sf_dir, "documents").select("doc_id", "text"),
                         table(spark, sf_dir, "benchmark"), keep_text=False)
    return summarise(found).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


SQL = r"""
WITH dw AS (SELECT doc_id, row_number() OVER () AS rid,
  list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
iw AS (SELECT DISTINCT coalesce(CAST(item_id AS varchar), '') AS item,
  list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
ip AS (SELECT DISTINCT item, list_slice(w, k, k + 9) AS p
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM iw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(p) AS m FROM ip),
dp AS (SELECT rid, m, k, list_slice(w, k, k + m - 1) AS p
  FROM (SELECT rid, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM dw, sizes WHERE len(w) >= m)),
hit AS (SELECT rid, item, k, m FROM dp JOIN ip USING (p)),
nh AS (SELECT rid, count(DISTINCT pos) AS n FROM (SELECT rid, unnest(range(k, k + m)) AS pos FROM hit) GROUP BY rid),
ni AS (SELECT rid, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY rid)
SELECT doc_id, coalesce(len(w), 0) AS n_words, coalesce(nh.n, 0) AS n_hit, coalesce(ni.n, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(nh.n, 0) > 0 AS contaminated
FROM dw LEFT JOIN nh USING (rid) LEFT JOIN ni USING (rid)"""
