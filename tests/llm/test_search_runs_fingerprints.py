"""Fingerprints, ranked search and runs of words against plain versions."""

import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction
from hashlib import sha256

import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerline.llm import catalog, fingerprints, lexical_search, periodic_runs

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "\n\t", "one", "One  one\x0bONE\tone", "é É é", "a b c d e", "a b c d e f", "😀 b c d", "x " * 3000]


def sha(text):
    return sha256(text.encode()).hexdigest()


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# ---------------------------------------------------------------- op11

def signed(x):
    return x - (1 << 64) if x >> 63 else x


def plain_print(text, size=5):
    """256 low-order parts, or an empty list."""
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    if not w:
        return []
    hashes = []
    for k in range(max(1, len(w) - size + 1)):
        h = 42
        for x in w[k:k + size]:
            h = xxhash.xxh64(x.encode(), seed=h).intdigest()
        hashes.append(signed(h))
    bins = {}
    for h in hashes:
        b = (h >> 56) + 128
        bins[b] = min(h, bins.get(b, h))
    out = []
    for j in range(256):
        if j in bins:
            out.append(bins[j] & 15)
        else:
            out.append(bins[min(bins, key=lambda b: fingerprints.order_key(j, b))] & 15)
    return out


def plain_likeness(a, b):
    if not a or not b:
        return float(a == b)
    p = sum(x == y for x, y in zip(a, b)) / 256
    return max(0.0, (p - 1 / 16) / (15 / 16))


def plain_op11(rows):
    """Sorted results; rows that repeat an id and a text stand together."""
    def key(r):
        i, t = r
        head = "-:" if i is None else f"{len(str(i))}:{i}"
        return (i is None, -(i or 0), sha(head + (t or ""))[:32])
    rows = sorted(rows, key=key)
    digits = lambda p: "".join(f"{x:x}" for x in p)
    out = []
    for k, (i, t) in enumerate(rows):
        text, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        own, changed, following = plain_print(text), plain_print(edited), plain_print(after)
        out.append((str(i), len(text), sha(edited), digits(own), digits(changed), round(plain_likeness(own, changed), 12),
                    round(plain_likeness(own, following), 12)))
    return sorted(out)


def spark_op11(df):
    return sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"],
                   round(r["near_edited"], 12), round(r["near_next"], 12)) for r in df.collect())


def test_fingerprints_equal_a_plain_version(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert spark_op11(catalog.QUERIES["op11_fingerprints"](spark, SF)) == plain_op11(rows)


def test_fingerprints_of_odd_and_repeated_rows(spark, tmp_path):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(3, "other text of three"), (7, "a b c d e"), (7, "a b c d e"), (7, "a b c d e"),
                                                  (None, "no id"), (None, None), (None, None), (50, "x " * 3000)]
    spark.createDataFrame([(*r, "e", 1) for r in rows], "doc_id bigint, text string, edited string, n_chars int").write.parquet(
        f"{tmp_path}/documents.parquet")
    assert spark_op11(fingerprints.op11_fingerprints(spark, str(tmp_path))) == plain_op11(rows)


def test_fingerprints_of_no_and_one_document(spark, tmp_path):
    for n in (0, 1):
        spark.createDataFrame([(5, "a b c d e f g")][:n], "doc_id bigint, text string").write.parquet(f"{tmp_path}/{n}/documents.parquet")
        got = spark_op11(fingerprints.op11_fingerprints(spark, f"{tmp_path}/{n}"))
        assert got == plain_op11([(5, "a b c d e f g")][:n])


def test_repetitions_are_made_without_one_array(spark):
    df = spark.createDataFrame([(1, 2500), (2, 1), (3, 1000)], "i int, times bigint")
    assert Counter(r["i"] for r in fingerprints.repeated(df, "times").collect()) == {1: 2500, 2: 1, 3: 1000}


def test_likeness_estimates_similarity(spark):
    """Mean error over pairs of known similarity, short sets included."""
    rnd, rows = random.Random(2), []
    for n in (30, 100, 400):
        for share in (0.0, 0.3, 0.5, 0.8, 0.95):
            for _ in range(25):
                common = round(2 * n * share / (1 + share))
                both = [f"w{rnd.random()}" for _ in range(common)]
                a, b = (both + [f"w{rnd.random()}" for _ in range(n - common)] for _ in range(2))
                # one shingle a "word": five equal words in a row stand for a member
                rows.append((n, share, common / (2 * n - common), a, b))
    df = spark.createDataFrame(rows, "n int, share double, real double, a array<string>, b array<string>")
    hashes = lambda c: F.transform(c, lambda w: F.xxhash64(w))
    lanes = lambda c: fingerprints.densify(fingerprints.bins_of(hashes(c)))
    got = df.select("n", "share", "real", lanes("a").alias("x"), lanes("b").alias("y")).collect()
    for n in (30, 100, 400):
        for share in (0.0, 0.3, 0.5, 0.8, 0.95):
            some = [r for r in got if r["n"] == n and r["share"] == share]
            made = [plain_likeness([v & 15 for v in r["x"]], [v & 15 for v in r["y"]]) for r in some]
            assert abs(sum(made) / len(made) - sum(r["real"] for r in some) / len(some)) < 0.05, (n, share)


# ---------------------------------------------------------------- op12

def plain_search(docs, items, k=10):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+",
                                "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    counts = [(i, Counter(find(t))) for i, t in docs]
    n_docs, length = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in counts:
            if not c:
                continue
            n = sum(c.values())
            m = 100 - 75 + (75 * n * n_docs) // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
                        for t in find(text) if c[t])
            if score > 0:
                found.append((-score, i is None, i if i is not None else 0, i))
        out += [(str(item), r, str(f[3]), -f[0]) for r, f in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


def spark_search(df):
    return sorted((str(r["item_id"]), r["rank"], str(r["doc_id"]), r["score"]) for r in df.collect())


def random_docs(seed, n):
    rnd = random.Random(seed)
    text = lambda m: " ".join(rnd.choice("abcdefghij") * rnd.choice((1, 1, 1, 2)) for _ in range(m))
    docs = [(k, text(rnd.randint(0, 40))) for k in range(n)]
    return docs, [(100 + k, text(rnd.randint(0, 12))) for k in range(25)]


@pytest.mark.parametrize("pairs, postings", [(200_000, 1 << 21), (40, 60), (200_000, 1)])
def test_search_equals_scoring_everything(spark, pairs, postings):
    docs, items = random_docs(pairs + postings, 300)
    docs += [(1000 + k, docs[7][1]) for k in range(30)] + [(None, docs[7][1]), (9, None), (9, ""), (9, "É é ÉÉ a_b a-b A1")]
    items += [(None, "a b"), (100, "é a1"), (101, None), (102, "nowhere"), (103, "b b b c")]
    got = spark_search(lexical_search.search(
        spark.createDataFrame([(*d, 1) for d in docs], "doc_id bigint, text string, score int").repartition(3),
        spark.createDataFrame(items, "item_id bigint, text string"), block_pairs=pairs, block_postings=postings))
    # items that share an id have rows each, so ranks may repeat under an id
    assert got == plain_search(docs, items)


def test_search_with_string_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([("d1", "a b"), ("d0", "a b"), ("d2", "c")], "doc_id string, text string")
    items = spark.createDataFrame([("i", "a")], "item_id string, text string")
    assert [(r[2], r[1]) for r in spark_search(lexical_search.search(docs, items))] == [("d0", 1), ("d1", 2)]
    assert lexical_search.search(docs.limit(0), items).count() == 0
    assert lexical_search.search(docs, items.limit(0)).count() == 0


def test_search_stops_before_the_end():
    """Best positions end the reading: most documents are never met."""
    import numpy as np
    rnd = random.Random(3)
    n = 4000
    terms, counts, offsets = [], [], [0]
    for k in range(n):
        own = sorted({rnd.randrange(3) if rnd.random() < 0.9 else 3 for _ in range(2)})
        terms += own
        counts += [1 + (k % 50 == 0) * 30 for _ in own]
        offsets.append(len(terms))
    block = lexical_search.Block(np.full(n, 40), np.array(offsets), np.array(terms, np.int32), np.array(counts, np.int32), n, 40 * n, 4)
    rows, scores, met = block.best(np.array([0, 1, 3]), np.array([5, 7, 9]), 10, [])
    assert met < n / 4 and len(rows) >= 10
    assert block.best(np.array([0, 1, 3]), np.array([5, 7, 9]), 10, [10 ** 12] * 10)[2] <= met


# ---------------------------------------------------------------- op13

def plain_runs(w, least=6, exponent=4):
    out = {}
    for q in range(1, len(w) // 2 + 1):
        k = 0
        while k + q < len(w):
            begin = k
            while k + q < len(w) and w[k] == w[k + q]:
                k += 1
            if k - begin >= q:
                out.setdefault((begin, k - begin + q), q)
            k += 1
    return sorted(((b, n, q) for (b, n), q in out.items() if n >= max(least, exponent * q)), key=lambda r: (r[0], r[2]))


def plain_op13(doc_id, text):
    w = words(text)
    if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0 and w:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [x if k < a else w[a + (k - a) % p] for k, x in enumerate(w)]
    runs = plain_runs(w)
    gone = {k for b, n, q in runs for k in range(b + q, b + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    return (str(doc_id), len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2],
            sha("".join(f"{b},{n},{q}\n" for b, n, q in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


def spark_op13(df):
    return sorted(((str(r["doc_id"]), *list(r)[1:]) for r in df.collect()), key=str)


def test_runs_equal_a_plain_search():
    rnd = random.Random(1)
    for _ in range(1200):
        texts = []
        for _ in range(rnd.randint(1, 5)):
            few = rnd.choice([1, 2, 3, 5])
            w = [rnd.randrange(few) for _ in range(rnd.randint(0, 50))]
            if rnd.random() < 0.4:
                w = w[:rnd.randint(1, 9)] * rnd.randint(1, 9) + w[:3]
            texts.append(w)
        for least, exponent in ((6, 4), (2, 2)):
            assert periodic_runs.runs_in(texts, least, exponent) == [plain_runs(w, least, exponent) for w in texts], texts


def test_runs_of_long_texts():
    """Long single runs and Fibonacci words take no quadratic time."""
    assert periodic_runs.runs_in([["a"] * 100_000]) == [[(0, 100_000, 1)]]
    assert periodic_runs.runs_in([["a", "b", "c"] * 30_000 + ["a"]]) == [[(0, 90_001, 3)]]
    a, b = "a", "ab"
    while len(b) < 3000:
        a, b = b, b + a
    assert periodic_runs.runs_in([list(b)], 2, 2) == [plain_runs(list(b), 2, 2)]


def test_runs_query_equals_a_plain_version(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = spark_op13(catalog.QUERIES["op13_periodic_runs"](spark, SF))
    assert got == sorted((plain_op13(*r) for r in rows), key=str)
    assert sum(r[1] > 0 for r in got) > 5


def test_runs_of_odd_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(periodic_runs, "BLOCK_WORDS", 50)
    rows = [(k, t) for k in range(60) for t in ODD] + [(None, "b " * 12 + "c"), (None, None)]
    spark.createDataFrame([(*r, 1, "r") for r in rows], "doc_id bigint, text string, n_runs int, runs string").write.parquet(
        f"{tmp_path}/documents.parquet")
    assert spark_op13(periodic_runs.op13_periodic_runs(spark, str(tmp_path))) == sorted((plain_op13(*r) for r in rows), key=str)
    kept = periodic_runs.find_runs(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    assert kept.columns == ["text", "doc_id", "n_runs", "n_words", "runs", "best", "collapsed"]
    assert kept.limit(0).count() == 0 and kept.where("n_runs = 1").count() == len(rows)
