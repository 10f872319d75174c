"""Ranked lexical search by the Best Position Algorithm.

The integer form of BM25 that is ranked by: a term's weight is
``w = floor(1000 ln((2N+2) / (2df+1)))``, its impact in a document with ``tf``
occurrences among ``n`` terms is ``(1e9 tf) div (1000 tf + 8m)`` with
``m = 25 + (75 n N) div L``, and a score sums ``w * impact`` over the item's
terms with repeats.  ``N`` counts documents with a term, ``L`` all terms,
``df`` documents with the term; all three come from the whole table.

1. ``index_documents``: one pass over the texts writes, for each document,
   its number of terms and the counts of those terms that occur in an item.
2. ``document_counts``: ``N``, ``L`` and ``df`` from that table.
3. ``rank``: documents are taken in blocks.  In a block every term has an
   impact list, highest first.  For an item, its lists are read from the top
   (sorted access, in steps that double).  A document met for the first time
   is scored whole from its own row (direct access), which also gives its
   position in each of the other lists; these positions are marked as seen.
   The *best position* of a list is the last one before its first unseen
   position, and no unseen document can score more than the sum of the
   impacts at the best positions.  Reading stops when that sum is strictly
   below the k-th best score so far (of this block and those before it in the
   task), so that documents of equal score are all met.
4. The k best of each task are ranked anew, first in salted groups, then by
   item.

Items reach the tasks in blocks of at most ``BLOCK_PAIRS`` (item, term) pairs,
one round of these steps for each, so what is broadcast and collected has a
bound however long the list of items is.

Style: numpy in Arrow batches; the only shuffles are of counts and of the k
best of each task.  A task holds one block of ``BLOCK_POSTINGS`` counts.

Defined results: null and empty texts and items have no terms; a document
without terms is not counted in ``N`` and never found; an item without terms,
or whose terms occur nowhere, has no rows; repeated documents are ranked each;
repeated items have rows each; null ids are kept, a null document id comes last
among equal scores; empty tables give no rows; very long texts are counted
whole; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_batches, stored, table
from .decontaminate import words_of

K = 10
BLOCK_PAIRS = 200_000
BLOCK_POSTINGS = 1 << 21
FIRST_DEPTH = 16
SALTS = 32
_IMPACT_BITS = 20


class Items:
    """Terms of a block of items: ``vocabulary`` (term -> number) and, for
    each item, term numbers and how often the item has them."""

    def __init__(self, rows: list[tuple[int, object, str | None]]):
        self.vocabulary: dict[bytes, int] = {}
        self.ordinals, self.ids, self.terms, self.repeats = [], [], [], []
        for ordinal, item, text in rows:
            counts = Counter(words_of(text))
            self.ordinals.append(ordinal)
            self.ids.append(item)
            self.terms.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in counts], np.int64))
            self.repeats.append(np.array(list(counts.values()), np.int64))


def term_weight(documents: int, having: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * having + 1)))


def index_documents(docs: DataFrame, vocabulary, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n, terms, counts): number of terms of each document that has
    any, and the counts of terms of the broadcast ``vocabulary``."""
    df = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))

    def run(batches):
        number = vocabulary.value
        size = max(len(number), 1)
        for batch in batches:
            found, rows, lengths = [], [], np.zeros(batch.num_rows, np.int64)
            for row, whole in enumerate(batch.column("text")):
                words = words_of(whole.as_py())
                lengths[row] = len(words)
                have = [number[w] for w in words if w in number]
                found += have
                rows.append(len(have))
            keys, counts = np.unique(np.repeat(np.arange(batch.num_rows), rows) * size + np.array(found, np.int64),
                                     return_counts=True)
            offsets = np.searchsorted(keys, np.arange(batch.num_rows + 1) * size).astype(np.int32)
            made = pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(lengths),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array((keys % size).astype(np.int32))),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(counts.astype(np.int32)))],
                names=["doc_id", "n", "terms", "counts"])
            yield made.filter(pa.array(lengths > 0))

    kind = df.schema["doc_id"].dataType.simpleString()
    return map_batches(df, run, f"doc_id {kind}, n bigint, terms array<int>, counts array<int>")


def document_counts(index: DataFrame, terms: int) -> tuple[int, int, np.ndarray]:
    """N, L and the df of each of ``terms`` terms, summed by Spark."""
    def run(batches):
        having = np.zeros(terms, np.int64)
        for batch in batches:
            having += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=terms)
        some = np.flatnonzero(having)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(having[some])], names=["term", "n"])

    total = index.agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l")).first()
    having = np.zeros(terms, np.int64)
    for r in map_batches(index.select("terms"), run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect():
        having[r["term"]] = r["n"]
    return total["n"], total["l"], having


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


class Block:
    """Impact lists of some documents, and the documents' own rows."""

    def __init__(self, n: np.ndarray, offsets: np.ndarray, terms: np.ndarray, counts: np.ndarray, documents: int,
                 length: int, vocabulary: int):
        self.offsets, self.terms = offsets, terms
        row = np.repeat(np.arange(len(n)), np.diff(offsets))
        m = 25 + (75 * n * documents) // length
        tf = counts.astype(np.int64)
        self.impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[row])
        # by term, then highest impact; equal impacts stay by row
        order = np.argsort((terms.astype(np.int64) << _IMPACT_BITS) + ((1 << _IMPACT_BITS) - 1 - self.impact), kind="stable")
        self.begin = np.concatenate([[0], np.cumsum(np.bincount(terms, minlength=vocabulary))])
        self.list_row, self.list_impact = row[order].astype(np.int32), self.impact[order]
        self.place = np.empty(len(order), np.int32)
        self.place[order] = np.arange(len(order)) - self.begin[terms[order]]
        self.rows = len(n)
        self.weight, self.slot = np.zeros(vocabulary, np.int64), np.zeros(vocabulary, np.int64)

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int, known: list[int]) -> tuple[np.ndarray, np.ndarray, int]:
        """(rows, scores, documents met): all rows that can be among the k
        best, given the scores of the k best ``known`` from elsewhere."""
        size = self.begin[terms + 1] - self.begin[terms]
        use = (size > 0) & (weights > 0)
        terms, weights, size = terms[use], weights[use], size[use]
        if not len(terms):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        begin, base = self.begin[terms], np.cumsum(size) - size
        self.weight[terms], self.slot[terms] = weights, base
        marked, met = np.zeros(int(size.sum()), bool), np.zeros(self.rows, bool)
        best_at = np.zeros(len(terms), np.int64)
        rows, scores, top = [], [], np.array(known, np.int64)
        read, depth = np.zeros(len(terms), np.int64), FIRST_DEPTH
        while True:
            # sorted access
            to = np.minimum(depth, size)
            new = self.list_row[_ranges(begin + read, to - read)]
            new = np.unique(new[~met[new]])
            read, depth = to, depth * 2
            if len(new):
                # direct access: the score, and the place in every list
                met[new] = True
                sizes = self.offsets[new + 1] - self.offsets[new]
                at = _ranges(self.offsets[new], sizes)
                weight = self.weight[self.terms[at]]
                scores.append(np.add.reduceat(weight * self.impact[at], np.cumsum(sizes) - sizes))
                rows.append(new)
                at = at[weight > 0]
                marked[self.slot[self.terms[at]] + self.place[at]] = True
                top = np.concatenate([top, scores[-1]])
                if len(top) > k:
                    top = np.partition(top, len(top) - k)[-k:]
            limit = 0
            for j, (b, s) in enumerate(zip(base.tolist(), size.tolist())):
                rest = marked[b + best_at[j]:b + s]
                if len(rest):
                    gap = int(rest.argmin())
                    best_at[j] += len(rest) if rest[gap] else gap
                if best_at[j] < s:
                    limit += int(weights[j]) * int(self.list_impact[begin[j] + best_at[j] - 1])
            if limit == 0 or (len(top) >= k and limit < int(top.min())):
                break
        self.weight[terms] = 0
        rows, scores = np.concatenate(rows), np.concatenate(scores)
        least = max(1, int(top.min())) if len(top) >= k else 1
        return rows[scores >= least], scores[scores >= least], int(met.sum())


def _by_rank(entry: tuple) -> tuple:
    score, doc = entry
    return -score, doc is None, doc if doc is not None else 0


def rank(index: DataFrame, items, weights, documents: int, length: int, id_type: pa.DataType, id_sql: str,
         k: int = K, block_postings: int = BLOCK_POSTINGS) -> DataFrame:
    """(ordinal, item_id, doc_id, score) of each task's k best for each item;
    ``items`` and ``weights`` (of the vocabulary) are broadcast."""
    doc_sql = index.schema["doc_id"].dataType.simpleString()

    def search(parts: list, best: list[list]) -> None:
        many, weight = items.value, weights.value
        n = np.concatenate([p.column("n").to_numpy() for p in parts])
        sizes = np.concatenate([np.diff(p.column("terms").offsets.to_numpy()) for p in parts]).astype(np.int64)
        flat = lambda name: np.concatenate([p.column(name).flatten().to_numpy() for p in parts])
        block = Block(n, np.concatenate([[0], np.cumsum(sizes)]), flat("terms"), flat("counts"), documents, length, len(weight))
        ids = pa.chunked_array([p.column("doc_id") for p in parts])
        for j, (terms, repeats) in enumerate(zip(many.terms, many.repeats)):
            rows, scores, _ = block.best(terms, weight[terms] * repeats, k, [s for s, _ in best[j]])
            if len(rows):
                entries = best[j] + list(zip(scores.tolist(), ids.take(pa.array(rows)).to_pylist()))
                best[j] = sorted(entries, key=_by_rank)[:k]

    def run(batches):
        best: list[list] = [[] for _ in items.value.ids]
        parts, held = [], 0
        for batch in batches:
            parts.append(batch)
            held += len(batch.column("terms").flatten())
            if held >= block_postings:
                search(parts, best)
                parts, held = [], 0
        if parts:
            search(parts, best)
        flat = [(j, s, d) for j, entries in enumerate(best) for s, d in entries]
        yield pa.RecordBatch.from_arrays(
            [pa.array([items.value.ordinals[j] for j, _, _ in flat], pa.int64()),
             pa.array([items.value.ids[j] for j, _, _ in flat], id_type),
             pa.array([d for _, _, d in flat], doc_type), pa.array([s for _, s, _ in flat], pa.int64())],
            names=["ordinal", "item_id", "doc_id", "score"])

    from pyspark.sql.pandas.types import to_arrow_type
    doc_type = to_arrow_type(index.schema["doc_id"].dataType)
    return map_batches(index, run, f"ordinal bigint, item_id {id_sql}, doc_id {doc_sql}, score bigint")


def best_of(found: DataFrame, k: int = K) -> DataFrame:
    """Adds ``rank`` and keeps the k best of each ordinal."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    salted = found.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("ordinal", "_salt").orderBy(*order))).where(F.col("rank") <= k)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("ordinal").orderBy(*order))).where(
        F.col("rank") <= k).drop("_salt")


def search(docs: DataFrame, benchmark: DataFrame, k: int = K, block_pairs: int = BLOCK_PAIRS,
           block_postings: int = BLOCK_POSTINGS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item."""
    from pyspark.sql.pandas.types import to_arrow_type
    spark = docs.sparkSession
    kind = benchmark.schema["item_id"].dataType
    # a term has a letter at least and a gap: two characters for a pair
    total = benchmark.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-total // (2 * block_pairs)))
    out, ordinal = None, 0
    for b in range(blocks):
        part = benchmark.select("item_id", "text")
        if blocks > 1:
            part = part.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        rows = [(ordinal + j, r["item_id"], r["text"]) for j, r in enumerate(part.collect())]
        ordinal += len(rows)
        items = Items(rows)
        index = stored(index_documents(docs, spark.sparkContext.broadcast(items.vocabulary)), "search-index")
        documents, length, having = document_counts(index, len(items.vocabulary))
        weights = np.array([term_weight(documents, int(h)) if h else 0 for h in having], np.int64)
        found = rank(index, spark.sparkContext.broadcast(items), spark.sparkContext.broadcast(weights), documents, max(length, 1),
                     to_arrow_type(kind), kind.simpleString(), k, block_postings)
        made = best_of(found, k).select("item_id", "rank", "doc_id", "score")
        out = made if out is None else out.unionByName(made)
    return out


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
  list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT row_number() OVER () AS iid, item_id,
  list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
c AS (SELECT count(*) AS docs, sum(len(w))::BIGINT AS words FROM d WHERE len(w) > 0),
q AS (SELECT iid, t, count(*) AS qtf FROM (SELECT iid, unnest(w) AS t FROM i) GROUP BY ALL),
p AS (SELECT rid, t, count(*) AS tf FROM (SELECT rid, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
f AS (SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS weight
  FROM (SELECT t, count(*) AS df FROM p GROUP BY t), c),
m AS (SELECT rid, doc_id, 100 - 75 + ((75 * len(w) * docs) // words) AS m FROM d, c WHERE len(w) > 0),
s AS (SELECT iid, rid, doc_id, sum(qtf * weight * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM q JOIN p USING (t) JOIN f USING (t) JOIN m USING (rid) GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM (SELECT item_id, doc_id, score,
  row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id ASC NULLS LAST)::INTEGER AS rank
  FROM s JOIN i USING (iid) WHERE score > 0) WHERE rank <= 10"""
