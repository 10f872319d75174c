"""Document fingerprints by one-permutation MinHash.

1. The distinct 5-word shingles of the lower-cased (A-Z) text are hashed once
   (64 bits; a text of fewer words is one shingle).  The top 8 bits name one
   of 256 bins, and a bin keeps its least hash.
2. Optimal densification: an empty bin takes the value of the first filled
   bin in an order of the bins of its own.  The orders are random, equal for
   all texts and independent of each other (bin ``b`` stands in the order of
   ``j`` by ``xxhash64(j, b)``), so an empty bin meets the same value in two
   texts as often as a filled one does.  The first ``PROBES`` places of each
   order are looked up one after the other; where all are empty, the filled
   bin with the least place is taken.
3. The 4 low-order bits of each bin are packed, 16 bins to a 64-bit word.
4. Likeness of two fingerprints: the share ``p`` of equal bins, corrected for
   chance matches: ``(p - c) / (1 - c)`` with ``c = 1/16``, held within 0 and 1.
   Its standard error for a similarity ``r`` is about ``sqrt(r (1 - r) / 256)``.

``neighbours`` gives each document the one that follows it in an order of the
whole table: rows are numbered by two-level ranks (``operators.positions``, on
keys and lengths only), and the beginning of the next text travels to the
document that needs it; no window holds texts, and no task a whole order.

Style: DataFrame expressions only.

Defined results: null and empty texts, and texts without words, have an empty
fingerprint; two empty ones are alike (1), an empty and another are not (0);
rows that repeat both id and text follow one another (each but the last is
followed by its own repetition); ids may be null (they come last); an empty
table gives an empty one; very long texts are hashed whole; of other columns
only the id is returned, so none can clash.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache, reduce

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.positions import positions
from .common import ascii_lower, stored, table

WORDS = 5
#: 2 ** BIN_BITS bins.
BIN_BITS = 8
BINS = 1 << BIN_BITS
LOW_BITS = 4
#: Places of a bin's order that are looked up before all filled bins are compared.
PROBES = 12
_LANES = 64 // LOW_BITS
_ONES = int("1" * _LANES, 16)


def order_key(bin_: int, other: int) -> int:
    """Place of ``other`` in the order of ``bin_``: xxhash64(bin_, other) as
    Spark computes it for two long values."""
    seed = xxhash.xxh64(bin_.to_bytes(8, "little"), seed=42).intdigest()
    made = xxhash.xxh64(other.to_bytes(8, "little"), seed=seed).intdigest()
    return made - (1 << 64) if made >> 63 else made


@cache
def _first_places() -> list[list[int]]:
    """For each probe, the bin that every bin looks up."""
    orders = [sorted((b for b in range(BINS) if b != j), key=lambda b: order_key(j, b))[:PROBES] for j in range(BINS)]
    return [[order[t] for order in orders] for t in range(PROBES)]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row."""
    return F.get(F.transform(F.array(value), body), 0)


def shingle_hashes(text: Column, size: int = WORDS) -> Column:
    """array<bigint>, in text order; repeated shingles repeat."""
    inner = F.btrim(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(" \t\n\x0b\x0c\r"))
    words = F.split(inner, r"[\x20\x09-\x0D]+")
    return let(words, lambda w: F.when(
        F.get(w, F.lit(0)) == "", F.array().cast("array<bigint>")).when(
        F.size(w) > size, F.transform(F.sequence(F.lit(1), F.size(w) - (size - 1)), lambda i: F.xxhash64(F.slice(w, i, size))))
        .otherwise(F.array(F.xxhash64(w))))


def _bin(h: Column) -> Column:
    """Number of a hash's bin, in the order of signed hashes."""
    return F.shiftright(h, 64 - BIN_BITS) + (BINS >> 1)


def bins_of(hashes: Column) -> Column:
    """array of ``BINS`` least hashes, null where a bin is empty; no bins for
    no hashes."""
    leasts = let(F.sort_array(hashes), lambda s: F.filter(
        s, lambda h, i: (i == 0) | (F.shiftright(h, 64 - BIN_BITS) != F.shiftright(F.get(s, i - 1), 64 - BIN_BITS))))
    gap = lambda n: F.array_repeat(F.lit(None).cast("bigint"), n.cast("int"))
    spaced = lambda m: F.flatten(F.transform(m, lambda h, i: F.concat(
        F.array(h), gap(F.coalesce(_bin(F.get(m, i + 1)), F.lit(BINS)) - _bin(h) - 1))))
    return let(leasts, lambda m: F.when(F.size(m) == 0, m).otherwise(F.concat(gap(_bin(F.get(m, 0))), spaced(m))))


def densify(bins: Column) -> Column:
    """Fills the empty bins of ``bins_of``."""
    probes = [F.array(*[F.lit(b) for b in row]) for row in _first_places()]

    def borrowed(all_: Column, filled: Column, j: Column) -> Column:
        near = [F.get(all_, F.get(p, j)) for p in probes]
        least = F.array_min(F.transform(filled, lambda h: F.struct(F.xxhash64(j.cast("bigint"), _bin(h)), h.alias("h"))))
        return F.coalesce(*near, least["h"])

    return let(bins, lambda b: let(F.array_compact(b), lambda filled: F.transform(
        b, lambda v, j: F.coalesce(v, borrowed(b, filled, j)))))


def fingerprint(text: Column) -> Column:
    """array<bigint> of packed low-order bits; empty without words."""
    dense = densify(bins_of(shingle_hashes(text)))
    pack = lambda part: F.aggregate(part, F.lit(0).cast("bigint"), lambda x, h: F.shiftleft(x, LOW_BITS).bitwiseOR(
        h.bitwiseAND(F.lit((1 << LOW_BITS) - 1).cast("bigint"))))
    return let(dense, lambda d: F.when(F.size(d) == 0, d).otherwise(F.transform(
        F.sequence(F.lit(0), F.lit(BINS // _LANES - 1)), lambda k: pack(F.slice(d, k * _LANES + 1, _LANES)))))


def as_text(packed: Column) -> Column:
    """Hexadecimal digits, one a bin."""
    return F.array_join(F.transform(packed, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two fingerprints, 0 to 1."""
    def unequal(x: Column) -> Column:
        x = reduce(lambda y, k: y.bitwiseOR(F.shiftrightunsigned(y, k)), (1, 2), x)
        return F.bit_count(x.bitwiseAND(F.lit(_ONES).cast("bigint")))

    counts = F.zip_with(a, b, lambda x, y: let(x.bitwiseXOR(y), unequal))
    other = F.aggregate(counts, F.lit(0), lambda n, k: n + k)
    chance = 1.0 / (1 << LOW_BITS)
    return (F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0))
            .when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0))
            .otherwise(F.greatest(F.lit(0.0), (F.lit(1.0) - other / F.lit(float(BINS)) - chance) / (1 - chance))))


def _row_key(doc_id: Column, text: Column) -> Column:
    """16 bytes of the digest of id and text."""
    name = doc_id.cast("string")
    head = F.coalesce(F.concat(F.length(name).cast("string"), F.lit(":"), name), F.lit("-:"))
    return F.unhex(F.substring(F.sha2(F.concat(head, text), 256), 1, 32))


def neighbours(docs: DataFrame, ascending: bool = False) -> DataFrame:
    """For each distinct (doc_id, text) of ``docs``: ``key``, ``next_key``
    (the row that follows by doc_id, then key; after the last, the first),
    ``doc_id``, ``n_chars`` and ``times``, how many rows are followed by it.
    Repetitions are followed by themselves."""
    rows = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select(_row_key(F.col("doc_id"), F.col("text")).alias("key"), "doc_id",
                       F.length("text").cast("bigint").alias("n_chars"))
    rows = rows.groupBy("key", "doc_id", "n_chars").agg(F.count("*").alias("times"))
    order = F.col("doc_id").asc_nulls_last() if ascending else F.col("doc_id").desc_nulls_last()
    placed = stored(positions(rows, [], [order, F.col("key")], "at", name="fingerprint-order"), "fingerprint-order")
    total = placed.count()
    after = placed.select(F.col("key").alias("next_key"), F.pmod(F.col("at") - 1, F.lit(max(total, 1))).alias("at"))
    pairs = placed.withColumn("times", F.lit(1).cast("bigint")).join(after, "at")
    again = placed.where("times > 1").withColumn("times", F.col("times") - 1).withColumn("next_key", F.col("key"))
    columns = ["key", "next_key", "doc_id", "n_chars", "times"]
    return pairs.select(*columns).unionByName(again.select(*columns))


def repeated(df: DataFrame, times: str) -> DataFrame:
    """Each row ``times`` times, without the column; no array of them all."""
    step = 1000
    return (df.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col(times) - 1) / step))))
            .withColumn("_one", F.explode(F.sequence(F.lit(1).cast("bigint"), F.least(F.lit(step), F.col(times) - F.col("_block") * step))))
            .drop("_block", "_one", times))


def edited_pairs(docs: DataFrame) -> DataFrame:
    """Each document with its edited text, whose second half (rounded down)
    is the beginning of the next document: ``doc_id``, ``n_chars``,
    ``edited`` and the packed ``own``, ``changed`` and ``following``
    fingerprints of text, edited text and next text."""
    links = stored(neighbours(docs), "fingerprint-links")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    texts = rows.select(_row_key(F.col("doc_id"), F.col("text")).alias("key"), "text").dropDuplicates(["key"])
    texts = texts.withColumn("mark", fingerprint(F.col("text")))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    heads = links.withColumnRenamed("key", "from").join(texts.withColumnRenamed("key", "next_key"), "next_key").select(
        F.col("from").alias("key"), "doc_id", "n_chars", "times", F.substring("text", F.lit(1), half).alias("head"),
        F.col("mark").alias("following"))
    made = heads.join(texts, "key").select(
        "doc_id", "n_chars", "times", "following", F.col("mark").alias("own"),
        F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - F.floor(F.col("n_chars") / 2)).cast("int")), "head").alias("edited"))
    return repeated(made.withColumn("changed", fingerprint(F.col("edited"))), "times")


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = edited_pairs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return pairs.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("changed")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("following")).alias("near_next"))
