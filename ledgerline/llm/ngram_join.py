"""N-gram Jaccard join with token-combination prefixes.

A document's set holds its distinct word ``n``-grams, as 64-bit hashes.  Two
documents link when their sets' Jaccard similarity is at least ``share`` per
cent; the result is the connected components of all links.

Steps, each a Spark job over whole tables:

1. *Sets.*  Per document the set's size, a digest, and two parity sketches
   (bit i: whether an odd number of members hash to i).  Their popcount of
   differences never exceeds the sets' symmetric difference, so a sketch can
   reject a pair but never a link.  Documents with equal digests are one
   class; its smallest id stands for it from here on.
2. *Frequency classes.*  Members are counted in a fixed number of hash
   buckets over the whole corpus.  A bucket well above the mean is frequent.
3. *Prefixes.*  All sets are ordered by (bucket count, hash).  Linked sets
   share a member in their prefixes of ``size - overlap + 1`` members, and
   ``l`` members when these are extended by ``l - 1``.  A rare member of the
   prefix is a key by itself.  If the first shared member is frequent, all
   are; then the extended prefix is dealt into ``B`` hash bins, ``B`` chosen
   by size class, and extended by ``B (k - 1)``: some bin must hold ``k``
   shared members, so the ``k``-combinations within bins are the keys.
4. *Stars.*  In each key's group the member of the least id is the pivot; the
   pairs of it and every other member are verified.
5. *The rest.*  Pairs of other members are joined only where their components
   still differ, once for all keys with the same members, after the filters
   by size, place and sketch; a pair that shares several combinations is made
   at the first of them only.  They are verified too, so no link between
   different components is lost.
6. *Components* of all verified links.
7. *Counts.*  A link stands inside a component, so all pairs of each component
   are compared, those too that the steps before had no need of.  A component
   is dealt into blocks of bounded size; a task holds two blocks at a time and
   counts the common members of all their pairs at once, so no pair is ever a
   row.

Pairs are verified on the full sets, which only documents in a pair that
passed the filters send; which these are is told by a bit map of fixed size
(false positives do no harm).  No group is gathered: groups are counted by
partial aggregation and joined, and AQE splits skewed joins.

Style: sets and keys in Python inside Arrow batches (numpy), the rest in
DataFrame operations.  Intermediate tables are written to the shared folder.

Defined results: null and empty texts have an empty set, which links with
nothing; a text of fewer than ``n`` words has one member, the whole sequence;
rows with the same id count as one document (each row shows its own set
size); a row without id links with nothing and has no component id.
"""

from __future__ import annotations

from functools import cache, reduce
from hashlib import blake2b
from itertools import combinations
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, map_batches, pack, stored, table, unpack
from .components import connected_components

WORDS, SHARE = 3, 90
COMBINATION = 2
#: Hash buckets for counts, bits of the bit maps, longs of the short sketch.
BUCKETS, BITS, LONGS = 1 << 20, 1 << 25, 16
CHUNK = BUCKETS // 64
#: A bucket is frequent from this multiple of the mean count, plus a constant.
FREQUENT, FREQUENT_LEAST = 4, 64
#: A document in more groups than this, or of several sizes (rows that share an id), doesn't carry their list: its
#: pairs may be made at several of them, with the same result.
GROUPS_LISTED = 64
#: Sets, and members of sets, in a block of a component (of which a task holds two), and cells of a matrix.
BLOCK_SETS, BLOCK_MEMBERS, CELLS = 1024, 1 << 18, 1 << 20
#: Rows and bytes of an Arrow batch.
BATCH_ROWS, BATCH_BYTES = 500, 4 << 20

U = np.uint64
_GAPS = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))
_BYTE = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_P = 0x9E3779B97F4A7C15
_P_INVERSE = pow(_P, -1, 1 << 64)


class _Powers:
    """Powers of an odd number modulo 2**64, as many as were ever needed."""

    def __init__(self, base: int):
        self.base, self.values = base, np.ones(1, U)

    def __call__(self, n: int) -> np.ndarray:
        if len(self.values) < n:
            size = max(n, 2 * len(self.values))
            self.values = np.cumprod(np.concatenate([np.ones(1, U), np.full(size - 1, self.base, U)]), dtype=U)
        return self.values[:n]


_up, _down = _Powers(_P), _Powers(_P_INVERSE)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(33))) * U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


def word_hashes(text: str) -> np.ndarray:
    """A hash of each word, from differences of a running polynomial."""
    data = np.frombuffer(text.encode().translate(_GAPS), np.uint8)
    inside = np.concatenate([[False], data != 32, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    if not len(edges):
        return np.zeros(0, U)
    start, stop = edges[::2], edges[1::2]
    run = np.concatenate([np.zeros(1, U), np.cumsum(_BYTE[data] * _up(len(data)), dtype=U)])
    return mix((run[stop] - run[start]) * _down(len(data))[start] + (stop - start).astype(U))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's word n-grams."""
    h = word_hashes(text) if text else np.zeros(0, U)
    if not len(h):
        return h
    size = min(len(h), words)
    out = np.full(len(h) - size + 1, size, U)
    for k in range(size):
        out = mix(out * U(0x87C37B91114253D5) + h[k:len(h) - size + 1 + k])
    return np.unique(out)


def sketch(members: np.ndarray, bits: int) -> np.ndarray:
    """Parity of the number of members in each of ``bits`` places, as bytes."""
    return np.packbits(np.bincount((members & U(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1)


def long_sketch(members: np.ndarray) -> bytes:
    """A sketch of as many bits as members, rounded up to a power of two."""
    return sketch(members, max(256, 1 << (len(members) - 1).bit_length())).tobytes()


def difference_at_least(a: bytes, b: bytes) -> int:
    """Lower bound of the symmetric difference from two long sketches; of
    different sizes, the larger is folded."""
    x, y = (np.frombuffer(s, np.uint8) for s in ((a, b) if len(a) <= len(b) else (b, a)))
    if len(y) > len(x):
        y = np.bitwise_xor.reduce(y.reshape(-1, len(x)))
    return int(np.bitwise_count(x ^ y).sum())


def links(common: int, a: int, b: int, share: int = SHARE) -> bool:
    return 100 * common >= share * (a + b - common)


def bucket_of(members: np.ndarray) -> np.ndarray:
    return (members >> U(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


@cache
def _bins(tag: int, share: int, k: int) -> int:
    """Bins of a size class's combinations: about as many as the prefix has
    members, and few enough that sets share ``bins * (k - 1) + 1`` members."""
    step = 100 / (share - 1)
    low, least = step ** tag, step ** (tag - 1)
    prefix = int(low) - ceil(share * int(low) / 100) + 1
    return max(1, min(prefix, (ceil(share * least / 100) - 1) // (k - 1)))


def prefix_keys(members: np.ndarray, counts: np.ndarray, frequent: float, share: int = SHARE,
                k: int = COMBINATION) -> tuple[np.ndarray, np.ndarray]:
    """Index keys of a set, and the place in its order of each key that is a
    rare member (-1 for combinations)."""
    n = len(members)
    prefix = n - -(-share * n // 100) + 1
    count = counts[bucket_of(members)]
    order = np.lexsort((members, count))
    members, often = members[order], count[order] >= frequent
    rare = np.flatnonzero(~often[:prefix])
    keys = [members[rare]]
    if often[:prefix].any():
        step = 100 / (share - 1)
        size_class = int(log(n) / log(step))
        for tag in (size_class, size_class + 1):
            bins = _bins(tag, share, k)
            last = prefix + bins * (k - 1)
            common = members[:last][often[:last]]
            bin_of = mix(common) % U(bins)
            by_bin = np.argsort(bin_of, kind="stable")
            common, bin_of = common[by_bin], bin_of[by_bin]
            borders = [0, *(np.flatnonzero(np.diff(bin_of)) + 1), len(common)]
            for a, b in zip(borders, borders[1:], strict=False):
                if b - a >= k:
                    sets = np.array(list(combinations(np.sort(common[a:b]), k)), U)
                    key = np.full(len(sets), (tag << 32) + k, U)
                    for j in range(k):
                        key = mix(key * U(0x87C37B91114253D5) + sets[:, j])
                    keys.append(key)
    keys = np.concatenate([keys[0], np.unique(np.concatenate([np.zeros(0, U), *keys[1:]]))])
    places = np.full(len(keys), -1, np.int32)
    places[:len(rare)] = rare
    return keys, places


# ---------------------------------------------------------------- tables

def _sets_batch(words: int):
    def run(batches):
        counts = np.zeros(BUCKETS, np.uint32)
        types = [pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * LONGS, pa.binary(), pa.int32()]
        for batch in batches:
            cols: list[list] = [[] for _ in types]
            for doc_id, whole in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
                members = shingles(whole.as_py(), words)
                np.add.at(counts, bucket_of(members), 1)
                short = sketch(members, 64 * LONGS).view(np.int64).tolist() if len(members) else [0] * LONGS
                row = [doc_id, len(members), blake2b(members.tobytes(), digest_size=16).digest(), *short,
                       long_sketch(members) if len(members) else b"", None]
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=_SET_COLS)
        parts = [(k, pack(p)) for k, p in enumerate(counts.reshape(-1, CHUNK)) if p.any()]
        if parts:
            n = len(parts)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()),
                 *(pa.nulls(n, pa.int64()) for _ in range(LONGS)), pa.array([p for _, p in parts], pa.binary()),
                 pa.array([k for k, _ in parts], pa.int32())], names=_SET_COLS)
    return run


_SET_COLS = ["id", "n", "digest", *(f"s{k}" for k in range(LONGS)), "sketch", "chunk"]
_SET_SCHEMA = "id bigint, n bigint, digest binary, " + ", ".join(f"s{k} bigint" for k in range(LONGS)) + \
    ", sketch binary, chunk int"


def _add_chunks(batches):
    """Sums of count arrays by chunk, one row each at the end."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, data in zip(batch.column("chunk").to_pylist(), batch.column("sketch"), strict=True):
            # sums stop at what four bytes hold
            sums[chunk] = np.minimum(sums.get(chunk, 0) + unpack(data.as_py()), (1 << 32) - 1)
    if sums:
        yield pa.RecordBatch.from_arrays(
            [pa.array([*sums], pa.int32()), pa.array([pack(v) for v in sums.values()], pa.binary())],
            names=["chunk", "sketch"])


def bucket_counts(sets: DataFrame) -> np.ndarray:
    """Members per bucket over the whole corpus: ``BUCKETS`` numbers."""
    parts = sets.where("chunk IS NOT NULL").select("chunk", "sketch")
    for salts in (8, 1):
        salt = F.pmod(F.xxhash64("sketch"), F.lit(salts))
        parts = parts.repartition("chunk", salt).mapInArrow(_add_chunks, "chunk int, sketch binary")
    counts = np.zeros((BUCKETS // CHUNK, CHUNK), np.uint32)
    for row in parts.collect():
        counts[row["chunk"]] = unpack(row["sketch"])
    return counts.reshape(-1)


def bit_map(ids: DataFrame, column: str) -> np.ndarray:
    """A bit for the hash of each id: ``BITS`` bits, however many ids."""
    place = F.pmod(F.xxhash64(F.col(column)), F.lit(BITS))
    words = ids.select(place.alias("p")).groupBy(F.floor(F.col("p") / 64).alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(p % 64 AS int))")).alias("bits")).toArrow()
    out = np.zeros(BITS // 64, np.int64)
    out[words["w"].to_numpy()] = words["bits"].to_numpy()
    return out


def _keep_marked(batch, words: np.ndarray) -> np.ndarray:
    """Rows of the batch whose bit is set."""
    place = batch.column("place").to_numpy()
    return np.flatnonzero((words[place // 64] >> (place % 64)) & 1)


def component_table(docs: DataFrame, id_column: str = "doc_id", text: str = "text", words: int = WORDS,
                    share: int = SHARE, k: int = COMBINATION, links: bool = True) -> DataFrame:
    """(id_column, n_shingles, component_id, n_links) of every document.
    ``n_links`` counts the classes that the document's class links with, all
    of them; without ``links`` the column is left out."""
    spark = docs.sparkSession
    bound_batches(spark, BATCH_ROWS, BATCH_BYTES)
    texts = docs.select(F.col(id_column).cast("bigint").alias("id"), F.col(text).alias("text"))
    sets = stored(map_batches(texts, _sets_batch(words), _SET_SCHEMA), "ngram-sets")
    rows = sets.where("chunk IS NULL")

    # 1: classes of equal sets
    full = rows.where("n > 0 AND id IS NOT NULL")
    classes = full.groupBy("digest").agg(F.min("id").alias("rep"))
    known = stored(full.select("id", "n", "digest").join(classes, "digest").select("id", "n", "rep"), "ngram-classes")
    reps = rows.join(known.select(F.col("id").alias("r"), F.col("rep").alias("r2")).where("r = r2").distinct(),
                     F.col("id") == F.col("r"), "left_semi")

    # 2 and 3: keys of the classes
    counts = bucket_counts(sets)
    frequent = float(FREQUENT * counts.mean() + FREQUENT_LEAST)
    sent = spark.sparkContext.broadcast(counts)
    placed = texts.where("id IS NOT NULL").withColumn("place", F.pmod(F.xxhash64("id"), F.lit(BITS)))

    def keys_of(ids: DataFrame) -> DataFrame:
        """Keys that the documents in ``ids`` share, with their pivots."""
        marks = spark.sparkContext.broadcast(bit_map(ids, "id"))

        def run(batches):
            for batch in batches:
                keys, ids, sizes, places = [np.zeros(0, U)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], \
                    [np.zeros(0, np.int32)]
                doc_ids, column = batch.column("id").to_numpy(), batch.column("text")
                for r in _keep_marked(batch, marks.value):
                    members = shingles(column[int(r)].as_py(), words)
                    # smaller sets can only link to equal ones
                    if 100 * len(members) >= share * (len(members) + 1):
                        made, at = prefix_keys(members, sent.value, frequent, share, k)
                        keys.append(made)
                        places.append(at)
                        ids.append(np.full(len(made), doc_ids[r]))
                        sizes.append(np.full(len(made), len(members), np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(ids)),
                     pa.array(np.concatenate(sizes), pa.int32()), pa.array(np.concatenate(places), pa.int32())],
                    names=["key", "id", "n", "place"])

        keys = stored(map_batches(placed, run, "key bigint, id bigint, n int, place int"), "ngram-keys")
        # the least id, whatever its size, so that keys with much the same members have the same pivot
        groups = keys.groupBy("key").agg(
            F.min("id").alias("pivot"), F.max("id").alias("last"), F.min_by("n", "id").alias("pivot_n"),
            F.min_by("place", "id").alias("pivot_place")).where("pivot <> last").drop("last").withColumnRenamed("key", "g")
        return stored(keys.join(groups, F.col("key") == F.col("g")).drop("g"), "ngram-shared")

    # the short sketches of all documents that share a key
    sketches = reps.select(F.col("id").alias("k_id"), *(f"s{j}" for j in range(LONGS)))
    sizes_fit = lambda a, b: (100 * F.least(a, b) >= share * F.greatest(a, b))
    # if this key is the pair's first shared member, all shared ones stand at or after it
    enough = lambda a, x, b, y: ((100 + share) * F.least(a - F.greatest(x, F.lit(0)), b - F.greatest(y, F.lit(0)))
                                 >= share * (a + b))
    most = lambda a, b: F.floor((a + b) * ((100 - share) / (100 + share)) + 1e-6)

    def apart(x: str, y: str):
        return sum((F.bit_count(F.col(f"{x}{j}").bitwiseXOR(F.col(f"{y}{j}"))) for j in range(LONGS)), F.lit(0))

    def with_sketch(df: DataFrame, column: str, prefix: str) -> DataFrame:
        side = sketches.select(F.col("k_id").alias(f"{prefix}id"), *(F.col(f"s{j}").alias(f"{prefix}{j}") for j in range(LONGS)))
        return df.join(side, F.col(column) == F.col(f"{prefix}id")).drop(f"{prefix}id")

    def stars_of(shared: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Verified links of the pivots, and the sets that were compared."""
        pairs = shared.where((F.col("id") != F.col("pivot")) & sizes_fit(F.col("n"), F.col("pivot_n"))
                             & enough(F.col("n"), F.col("place"), F.col("pivot_n"), F.col("pivot_place"))).select(
            F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b"), (F.col("n") + F.col("pivot_n")).alias("nn"),
        ).distinct()
        pairs = with_sketch(with_sketch(pairs, "a", "x"), "b", "y").where(
            apart("x", "y") <= most(F.col("nn"), F.lit(0))).select("a", "b", "nn")
        return _verify(pairs, reps, placed, words, share)

    group = ["h", "h2", "m"]

    def left_apart(shared: DataFrame, links: DataFrame) -> DataFrame:
        """Members, but for the pivots, of groups in more than one component."""
        grouped = connected_components(links, "ngram-stars")
        members = shared.join(grouped, F.col("id") == F.col("node"), "left").select(
            "key", "id", "n", "place", "pivot", F.coalesce("component", "id").alias("c"))
        apart_keys = members.groupBy(F.col("key").alias("g")).agg(
            F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 <> c1")
        kept = members.join(apart_keys.select("g"), F.col("key") == F.col("g")).where("id <> pivot").groupBy("key", "id").agg(
            F.min("place").alias("place"), F.min("n").alias("n"), F.min("c").alias("c"))
        # keys with the same members (by count and 128 bits of their hashes) are one, with each member's least place
        same = kept.groupBy(F.col("key").alias("g")).agg(
            F.count("*").alias("m"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("h"),
            F.bit_xor(F.xxhash64("id", F.lit(2))).alias("h2"), F.min("place").alias("rare")).where("m > 1").select(
            "g", "m", "h", "h2", (F.col("rare") >= 0).alias("rare"))
        return stored(kept.join(same, F.col("key") == F.col("g")).groupBy(*group, "rare", "id").agg(
            F.min("place").alias("place"), F.min("n").alias("n"), F.min("c").alias("c")), "ngram-left")

    # 4: stars
    shared = keys_of(known.where("id = rep"))
    found, compared = stars_of(shared)
    left = left_apart(shared, found)

    # 5: the pairs left; a document's list of combinations, by which a pair is made at the first that both share
    lists = left.where("NOT rare").select("id", "h").join(
        left.where("NOT rare").groupBy(F.col("id").alias("l_id")).agg(
            F.count("*").alias("l_n"), F.min("n").alias("n0"), F.max("n").alias("n1")).where(
            (F.col("l_n") <= GROUPS_LISTED) & (F.col("n0") == F.col("n1"))), F.col("id") == F.col("l_id"), "left_semi").groupBy(
        F.col("id").alias("l_id")).agg(F.collect_list("h").alias("l"))
    rows_left = left.join(lists, F.col("id") == F.col("l_id"), "left").drop("l_id")
    others = stored(with_sketch(rows_left, "id", "x"), "ngram-others")
    columns = ["h", "h2", "m", "rare", "id", "n", "place", "c", "l"]
    left = others.select(*columns, *(F.col(f"x{j}") for j in range(LONGS)))
    right = others.select(*(F.col(c).alias(f"{c}_2") for c in columns), *(F.col(f"x{j}").alias(f"y{j}") for j in range(LONGS)))
    rest = left.join(right, (F.col("h") == F.col("h_2")) & (F.col("h2") == F.col("h2_2")) & (F.col("m") == F.col("m_2"))
                     & (F.col("rare") == F.col("rare_2"))
                     & (F.col("c") < F.col("c_2")) & sizes_fit(F.col("n"), F.col("n_2"))
                     & enough(F.col("n"), F.col("place"), F.col("n_2"), F.col("place_2"))
                     & (apart("x", "y") <= most(F.col("n"), F.col("n_2")))
                     & (F.col("rare") | F.col("l").isNull() | F.col("l_2").isNull()
                        | (F.array_min(F.array_intersect("l", "l_2")) == F.col("h")))).select(
        F.least("id", "id_2").alias("a"), F.greatest("id", "id_2").alias("b"), (F.col("n") + F.col("n_2")).alias("nn")).distinct()
    found_left, compared_left = _verify(rest, reps, placed, words, share)
    found = stored(found.union(found_left).distinct(), "ngram-links")

    # 6: components; rows that share an id are one document
    same_id = known.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b")
    all_reps = known.select("id", "rep").join(same_id.select(F.col("id").alias("i"), "a"), F.col("id") == F.col("i")).select(
        "a", F.col("rep").alias("b"))
    components = connected_components(found.select("a", "b").union(all_reps), "ngram-components")
    out = rows.select("id", F.col("n").alias("n_shingles"), F.when(
        (F.col("n") > 0) & F.col("id").isNotNull(), F.col("digest"))
        # rows without a class are spread: eight bytes equal no digest
        .otherwise(F.unhex(F.hex(F.xxhash64("id")))).alias("digest")).join(classes, "digest", "left")
    out = out.join(components, F.col("rep") == F.col("node"), "left")
    columns = [F.col("id").alias(id_column), "n_shingles", F.coalesce("component", "rep", "id").alias("component_id")]
    if links:
        # 7: every end of a link was compared once
        ends = link_counts(compared.union(compared_left), components, share)
        out = out.join(ends, F.col("rep") == F.col("e"), "left")
        columns.append(F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
    return out.select(*columns)


def _verify(pairs: DataFrame, reps: DataFrame, placed: DataFrame, words: int, share: int) -> tuple[DataFrame, DataFrame]:
    """The pairs (a, b) that link, first by long sketches, then by full sets;
    and these sets (id, v), some more among them."""
    side = lambda c, v, df: df.select(F.col("id").alias(c), F.col(v).alias(f"{c}_v"))
    both = pairs.join(side("ai", "sketch", reps), F.col("a") == F.col("ai")).join(
        side("bi", "sketch", reps), F.col("b") == F.col("bi")).select("a", "b", "nn", "ai_v", "bi_v")

    def near(batches):
        for batch in batches:
            ok = [r for r, (nn, x, y) in enumerate(zip(batch.column("nn").to_pylist(), batch.column("ai_v").to_pylist(),
                                                       batch.column("bi_v").to_pylist(), strict=True))
                  if (100 + share) * difference_at_least(x, y) <= (100 - share) * nn]
            yield batch.select(["a", "b"]).take(pa.array(ok, pa.int64()))

    near_pairs = stored(both.mapInArrow(near, "a bigint, b bigint"), "ngram-near")
    ids = near_pairs.select(F.col("a").alias("i")).union(near_pairs.select(F.col("b").alias("i"))).distinct()
    marks = pairs.sparkSession.sparkContext.broadcast(bit_map(ids, "i"))

    def set_rows(batches):
        for batch in batches:
            at = _keep_marked(batch, marks.value)
            column = batch.column("text")
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(at)),
                 pa.array([shingles(column[int(r)].as_py(), words).tobytes() for r in at], pa.binary())], names=["id", "v"])

    members = stored(map_batches(placed, set_rows, "id bigint, v binary"), "ngram-members")
    both = near_pairs.join(side("ai", "v", members), F.col("a") == F.col("ai")).join(
        side("bi", "v", members), F.col("b") == F.col("bi")).select("a", "b", "ai_v", "bi_v")

    def linked(batches):
        for batch in batches:
            ok = []
            for r, (x, y) in enumerate(zip(batch.column("ai_v"), batch.column("bi_v"), strict=True)):
                x, y = np.frombuffer(x.as_py(), U), np.frombuffer(y.as_py(), U)
                if links(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), share):
                    ok.append(r)
            yield batch.select(["a", "b"]).take(pa.array(ok, pa.int64()))

    return stored(both.mapInArrow(linked, "a bigint, b bigint").distinct(), "ngram-verified"), members


def link_counts(sets: DataFrame, components: DataFrame, share: int = SHARE) -> DataFrame:
    """(e, n_links): with how many other ids each id links, of the ids' ``sets``
    (id, v; repeated or not, several of an id are that id's).  All pairs of a
    component's sets are compared, two blocks of sets at a time; a set is sent
    once for each block of its component."""
    sets = stored(sets.repartition("id").dropDuplicates(["id", "v"]).join(components, F.col("id") == F.col("node")).select(
        "component", "id", "v", F.floor(F.octet_length("v") / 8).alias("n"), F.xxhash64("id", "v").alias("deal")), "ngram-linked")
    # a pair of ids of which one has several sets may link more than once: such pairs are given out, others only counted
    several = sets.groupBy(F.col("id").alias("s")).count().where("count > 1").select("s")
    blocks = sets.groupBy(F.col("component").alias("c")).agg(F.ceil(F.greatest(
        F.count("*") / BLOCK_SETS, F.sum("n") / BLOCK_MEMBERS)).alias("k")).where("k > 1")
    dealt = sets.join(several, F.col("id") == F.col("s"), "left").join(blocks, F.col("component") == F.col("c"), "left").select(
        "component", "id", "v", F.col("s").isNotNull().alias("several"), F.coalesce("k", F.lit(1)).alias("k"),
        F.pmod("deal", F.coalesce("k", F.lit(1))).alias("own"))
    met = dealt.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("k") - 1)).alias("other")).select(
        "component", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "id", "several", "v")
    met = met.repartition("component", "x", "y").sortWithinPartitions("component", "x", "y")
    counted = stored(map_batches(met, _blocks_batch(share), "id bigint, other bigint, n bigint"), "ngram-counts")
    pairs = counted.where("other IS NOT NULL").select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
    ends = [counted.where("other IS NULL").select(F.col("id").alias("e"), "n"),
            *(pairs.select(F.col(c).alias("e"), F.lit(1).cast("bigint").alias("n")) for c in "ab")]
    return reduce(DataFrame.union, ends).groupBy("e").agg(F.sum("n").alias("n_links"))


def common_members(left: list[np.ndarray], right: list[np.ndarray] | None = None) -> np.ndarray:
    """How many members each set on the left shares with each on the right (or
    with each other on the left), from products of matrices that have a bounded
    number of cells."""
    if right is None:
        values, times = np.unique(np.concatenate(left), return_counts=True)
        values = values[times > 1]
    else:
        values = np.intersect1d(np.concatenate(left), np.concatenate(right))
    marks = []
    for sets in (left, right or left):
        at, every = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets)
        place = np.searchsorted(values, every)
        shared = np.append(values, U(0))[place] == every
        shared &= place < len(values)
        marks.append((len(sets), at[shared], place[shared]))
    out = np.zeros([n for n, _, _ in marks], np.int64)
    step = max(1, CELLS // max(out.shape))
    for low in range(0, len(values), step):
        sides = []
        for n, at, place in marks[:1 if right is None else 2]:
            here = (place >= low) & (place < low + step)
            sides.append(np.zeros((n, min(step, len(values) - low)), np.float32))   # exact up to 2**24 members
            sides[-1][at[here], place[here] - low] = 1
        out += (sides[0] @ sides[-1].T).astype(np.int64)
    return out


def _blocks_batch(share: int):
    """Links between the sets of two blocks (or inside one), which stand in a
    row: for each id its number of links, or the pairs (``several``)."""
    def compare(rows: list, one: bool):
        first = min((r[0] for r in rows), default=None)
        sides = [rows] if one else [[r for r in rows if r[0] == first], [r for r in rows if r[0] != first]]
        if len(rows) < 2 or not all(sides):
            return
        sets = [[np.frombuffer(r[3], U) for r in side] for side in sides]
        common = common_members(*sets)
        ids, several, sizes = ([np.array(x) for x in (f(sides[0]), f(sides[-1]))] for f in (
            lambda side: [r[1] for r in side], lambda side: [r[2] for r in side], lambda side: [len(r[3]) // 8 for r in side]))
        for at in range(0, len(common), 256):
            part = slice(at, at + 256)
            link = (100 * common[part] >= share * (sizes[0][part, None] + sizes[1] - common[part])) & (ids[0][part, None] != ids[1])
            if one:
                link &= np.arange(len(common))[part, None] < np.arange(len(common))
            given = link & (several[0][part, None] | several[1])
            x, y = np.nonzero(given)
            yield ids[0][part][x], ids[1][y], np.ones(len(x), np.int64)
            link &= ~given
            for side, n in ((ids[0][part], link.sum(1)), (ids[1], link.sum(0))):
                yield side[n > 0], None, n[n > 0]

    def made(out):
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([i for i, _, _ in out])),
             pa.concat_arrays([pa.nulls(len(i), pa.int64()) if o is None else pa.array(o) for i, o, _ in out]),
             pa.array(np.concatenate([n for _, _, n in out]))], names=["id", "other", "n"])

    def run(batches):
        key, rows, out = None, [], []
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("component", "x", "y")), strict=True)
            values = zip(*(batch.column(c).to_pylist() for c in ("own", "id", "several", "v")), strict=True)
            for now, row in zip(keys, values, strict=True):
                if now != key:
                    out.extend(compare(rows, key is None or key[1] == key[2]))
                    key, rows = now, []
                rows.append(row)
            if out:
                yield made(out)
                out = []
        out.extend(compare(rows, key is None or key[1] == key[2]))
        if out:
            yield made(out)
    return run


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return component_table(table(spark, sf_dir, "documents").select("doc_id", "text"))
