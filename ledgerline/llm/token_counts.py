"""Token counts with the whole-token shortcut.

For a BPE vocabulary with word ends, every vocabulary string is first merged
by itself: those that end as one token are *whole*.  Counting then looks each
pre-token up in that set and counts one; only the rest is merged.  The set is
made once per worker from the vocabulary file alone.

Texts go through the file's own steps: special strings count one token and
cut the text; the pieces between are put in NFC and lower case, split into
pre-tokens and read as bytes.  Counts equal the library's.

Style: Python inside Arrow batches, with counts of blank-separated words
cached per worker within a bound.  No shuffle; a lost task just runs again.

Defined results: null text counts as empty, an empty text has 0 tokens;
repeated rows each get a result; other columns are kept unless their names
clash with added ones, which then replace them.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordCache, map_batches, table, tokenizer_path

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
INF = float("inf")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies:
    printable Latin-1 stands for itself, the rest follows from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordBpe:
    """A byte-level BPE vocabulary whose last letter carries a word end."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        steps = [s["type"] for s in spec["normalizer"]["normalizers"]]
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        if (model["type"], steps, split["type"], level["type"], level["use_regex"]) != (
                "BPE", ["NFC", "Replace", "Lowercase"], "Split", "ByteLevel", False) or not split["invert"]:
            raise ValueError("not a vocabulary of the kind that is counted here")
        self.end = model["end_of_word_suffix"]
        self.rank = {tuple(m): k for k, m in enumerate(model["merges"])}
        self.pre_tokens = regex.compile(split["pattern"]["Regex"]).findall
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]))
        self.letter = byte_letters()
        special = {t["content"] for t in spec["added_tokens"]}
        #: Vocabulary strings that merge to one token, without their word end.
        self.whole = {t[:-len(self.end)] for t in model["vocab"]
                      if t.endswith(self.end) and t not in special and len(self.merge(t[:-len(self.end)])) == 1}

    def merge(self, letters: str) -> list[str]:
        """Symbols of a pre-token after all merges: lowest rank first, of
        equal ranks the leftmost."""
        parts = [*letters[:-1], letters[-1:] + self.end]
        if len(parts) > 48:
            return self._merge_long(parts)
        while len(parts) > 1:
            best, k = min((self.rank.get((parts[k], parts[k + 1]), INF), k) for k in range(len(parts) - 1))
            if best == INF:
                break
            parts[k:k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def _merge_long(self, parts: list[str]) -> list[str]:
        n = len(parts)
        after, before, gone = [*range(1, n), -1], [*range(-1, n - 1)], bytearray(n)
        heap = [(r, k, parts[k], parts[k + 1]) for k in range(n - 1)
                if (r := self.rank.get((parts[k], parts[k + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, k, a, b = heapq.heappop(heap)
            j = after[k]
            if gone[k] or j < 0 or parts[k] != a or parts[j] != b:
                continue
            parts[k], gone[j], after[k] = a + b, 1, after[j]
            if after[k] >= 0:
                before[after[k]] = k
            for x in (before[k], k):
                if x >= 0 and after[x] >= 0:
                    r = self.rank.get((parts[x], parts[after[x]]))
                    if r is not None:
                        heapq.heappush(heap, (r, x, parts[x], parts[after[x]]))
        return [p for p, g in zip(parts, gone, strict=True) if not g]

    def count_word(self, word: str) -> int:
        """Tokens of a stretch without white space, already normalised."""
        n = 0
        for piece in self.pre_tokens(word):
            letters = "".join(map(self.letter.__getitem__, piece.encode()))
            n += 1 if letters in self.whole else len(self.merge(letters))
        return n


@cache
def load(path: str) -> WordBpe:
    return WordBpe(path)


@cache
def _counts(path: str) -> WordCache:
    return WordCache(load(path).count_word, 400_000)


def count_text(text: str, path: str) -> int:
    """Tokens of a whole text."""
    model, counts, n = load(path), _counts(path), 0
    parts = [text]
    if "<|" in text:
        parts = model.special.split(text)
        n = len(parts) - 1
    for part in parts:
        if not part.isascii():
            # lower-casing is letter by letter: a capital sigma at a word's end is no exception
            part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
        part = part.lower()
        if re.search(r"[\x1c-\x1f]", part):  # white space for str.split alone
            n += model.count_word(part)
        else:
            n += sum(map(counts.__getitem__, part.split()))
    return n


def count_tokens(docs: DataFrame, text: str = "text", limit: int = LIMIT, path: str | None = None,
                 keep_text: bool = True) -> DataFrame:
    """``docs`` plus ``n_bytes``, ``n_tokens`` and ``over_limit``."""
    path = path or tokenizer_path(VOCABULARY)
    added = ("n_bytes", "n_tokens", "over_limit")
    rows = docs.drop(*[c for c in added if c != text])
    kept = [f for f in rows.schema.fields if f.name not in added and (keep_text or f.name != text)]
    names = [f.name for f in kept]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept),
                        "n_bytes bigint", "n_tokens bigint"])

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array([len(t.encode()) for t in texts], pa.int64()),
                 pa.array([count_text(t, path) for t in texts], pa.int64())],
                names=[*names, "n_bytes", "n_tokens"])

    return map_batches(rows, run, schema).withColumn("over_limit", F.col("n_tokens") > limit)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
