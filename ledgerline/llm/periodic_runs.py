"""Runs of words: maximal stretches that repeat a period.

A run is a stretch of consecutive words with smallest period ``q`` (words
``q`` apart are identical) that cannot be extended on either side; it is
reported from ``least`` words and ``exponent`` periods on.

Method (branching tandem test on an enhanced suffix array), for a block of
texts laid one after the other, each ended by a symbol of its own:

1. suffix array and its inverse by prefix doubling, only over suffixes whose
   order is still open; LCP values in text order;
2. every LCP boundary ``x`` of depth ``d`` splits its interval in two parts
   (bounds by a stack of boundaries; no tree nodes).  For each suffix ``i`` of
   the smaller part, ``ISA[i + d]`` or ``ISA[i - d]`` inside the other part
   means a square of period ``d`` whose next word breaks the period (suffixes
   ``d`` apart with exactly ``d`` words in common).  A suffix is in the smaller
   part O(log n) times;
3. each square is rotated to the left as far as its period holds, which gives
   the run that ends with it.  A square whose period is a multiple of one that
   covers it is the same run and goes.

Word numbers are given per text, so equal words of two texts never share an
interval, and copies cost nothing more.

Style: numpy and lists inside Arrow batches, no shuffle: a text is one row and
its runs need nothing else.  Memory grows with ``BLOCK_WORDS`` or the longest
text, about 150 bytes a word.

Defined results: null and empty texts have no words and no runs, and collapse
to an empty text; repeated rows each get their result; an empty table gives an
empty one; very long texts are a block of their own; other columns are kept,
those named ``n_words``, ``runs`` or ``collapsed`` are replaced.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, table

LEAST_WORDS, EXPONENT = 6, 4
BLOCK_WORDS = 1 << 18
#: Suffixes that step 2 tests at once.
_TESTS = 1 << 20


def suffix_ranks(s: np.ndarray) -> np.ndarray:
    """ISA of ``s``, whose last symbol and the symbols that end its texts
    occur once each."""
    n = len(s)
    act = np.argsort(s, kind="stable")
    key = s[act]
    rank = np.empty(n, np.int64)
    old = np.zeros(n, np.int64)
    h = 0
    while len(act):
        at = np.arange(len(act))
        first = np.concatenate([[True], key[1:] != key[:-1]])
        begins = np.maximum.accumulate(np.where(first, at, 0))
        group = np.concatenate([[True], old[1:] != old[:-1]])
        rank[act] = new = old + begins - np.maximum.accumulate(np.where(group, at, 0))
        single = first & np.concatenate([first[1:], [True]])
        act, old = act[~single], new[~single]
        h = 2 * h or 1
        # groups are equal in h symbols, and no text's end is one of them
        key = old * n + rank[act + h]
        order = np.argsort(key, kind="stable")
        act, key, old = act[order], key[order], old[order]
    return rank


def lcp_values(s: np.ndarray, sa: np.ndarray, isa: np.ndarray) -> np.ndarray:
    """Common words of each suffix in ``sa`` with the one before it."""
    before = np.empty(len(s), np.int64)
    before[sa[1:]] = sa[:-1]
    before[sa[0]] = sa[0]
    shared = s[before] == s
    shared[sa[0]] = False
    places = np.flatnonzero(shared)
    word, values, last, h = s.tolist(), [], -2, 0
    for i, j in zip(places.tolist(), before[places].tolist()):
        h = h - 1 if h > 1 and i == last + 1 else 1
        while word[i + h] == word[j + h]:
            h += 1
        values.append(h)
        last = i
    out = np.zeros(len(s), np.int64)
    out[isa[places]] = values
    return out


def boundaries(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, left, right) of boundaries deeper than 0: the parts are
    ``[left, x)`` and ``[x, right)``; of equally deep boundaries the first one
    parts what the later ones hold."""
    deep = np.flatnonzero(lcp > 0)
    left, right, stack, last = [0] * len(deep), [0] * len(deep), [], -2
    places, depths = deep.tolist(), lcp[deep].tolist()
    for k, x in enumerate(places):
        if x != last + 1:
            for top in stack:
                right[top] = last + 1
            stack.clear()
            bottom = x - 1
        d = depths[k]
        while stack and depths[stack[-1]] > d:
            right[stack.pop()] = x
        left[k] = places[stack[-1]] if stack else bottom
        stack.append(k)
        last = x
    for top in stack:
        right[top] = last + 1
    return deep, np.array(left, np.int64), np.array(right, np.int64)


def branching_squares(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of the squares whose next word breaks the period."""
    isa = suffix_ranks(s)
    sa = np.empty(len(s), np.int64)
    sa[isa] = np.arange(len(s))
    lcp = lcp_values(s, sa, isa)
    x, left, right = boundaries(lcp)
    low = x - left <= right - x
    begin, size = np.where(low, left, x), np.where(low, x - left, right - x)
    other, stop = np.where(low, x, left), np.where(low, right, x)
    depth, done, found = lcp[x], np.cumsum(size), []
    at = 0
    while at < len(x):
        to = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + _TESTS, "right")))
        n = size[at:to]
        node = np.repeat(np.arange(at, to), n)
        i = sa[np.repeat(begin[at:to] - (np.cumsum(n) - n), n) + np.arange(len(node))]
        d, a, b = depth[node], other[node], stop[node]
        # i + d is still in the array: i and another suffix share d words, after which a symbol follows
        up = isa[i + d]
        hit = (up >= a) & (up < b)
        found.append((i[hit], d[hit]))
        down = isa[np.maximum(i - d, 0)]
        hit = (i >= d) & (down >= a) & (down < b)
        found.append((i[hit] - d[hit], d[hit]))
        at = to
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _rotate(s: np.ndarray, word: list[int], start: int, period: int) -> int:
    """Where the run of a square begins.  No run crosses the end symbols."""
    for _ in range(32):
        if start == 0 or word[start - 1] != word[start - 1 + period]:
            return start
        start -= 1
    step = 64
    while start:
        low = max(0, start - step)
        broken = np.flatnonzero(s[low:start] != s[low + period:start + period])
        if len(broken):
            return low + int(broken[-1]) + 1
        start, step = low, step * 4
    return 0


def runs_of(s: np.ndarray, least: int = LEAST_WORDS, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) in ``s``, by start, then period."""
    start, period = branching_squares(s)
    end = start + 2 * period
    order = np.lexsort((period, end))
    word, out, last, ending = s.tolist(), [], -1, []
    for i, q, e in zip(start[order].tolist(), period[order].tolist(), end[order].tolist()):
        if e != last:
            last, ending = e, []
        if any(q % p == 0 and b <= i for b, p in ending):
            continue
        begin = _rotate(s, word, i, q)
        ending.append((begin, q))
        if e - begin >= max(least, exponent * q):
            out.append((begin, e - begin, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def runs_in(texts: list[list], least: int = LEAST_WORDS, exponent: int = EXPONENT) -> list[list[tuple[int, int, int]]]:
    """Runs of each list of words, all lists in one suffix array."""
    numbers, base = [], 0
    for words in texts:
        own: dict = {}
        numbers += [own.setdefault(w, base + len(own)) for w in words]
        base += len(own) + 1
        numbers.append(base - 1)
    begins = np.cumsum([0] + [len(w) + 1 for w in texts])
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if numbers:
        found = runs_of(np.array(numbers, np.int64), least, exponent)
        owners = np.searchsorted(begins, [r[0] for r in found], "right") - 1
        for k, (start, length, period) in zip(owners.tolist(), found):
            out[k].append((start - int(begins[k]), length, period))
    return out


def collapse(words: list, runs: list[tuple[int, int, int]]) -> list:
    """Words that no run contains after its first period."""
    if not runs:
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return [w for w, g in zip(words, np.cumsum(gone)) if not g]


def words_of(text: str | None) -> list[bytes]:
    return text.encode().split() if text else []


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with most periods; ties: least start, then least period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_RUN_SQL = "struct<start:bigint,length:bigint,period:bigint>"


def find_runs(docs: DataFrame, text: str = "text", least: int = LEAST_WORDS, exponent: int = EXPONENT,
              keep_text: bool = True) -> DataFrame:
    """``docs`` plus ``n_words``, ``runs`` (start, length, period), ``best``
    (the run with most periods, or null) and ``collapsed`` (the words that no
    run repeats, joined by one space)."""
    added = ("n_words", "runs", "best", "collapsed")
    kept = [c for c in docs.columns if c not in added and c != text]
    out = docs.select(F.col(f"`{text}`"), *[F.col(f"`{c}`") for c in kept])
    keep = [text, *kept] if keep_text else kept
    types = [f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields if f.name in keep]

    def run(batches):
        for batch in batches:
            column, done = batch.column(0), 0
            while done < len(column):
                block, size, first = [], 0, done
                while done < len(column) and (not block or size + len(words) <= BLOCK_WORDS):
                    block.append(words_of(column[done].as_py()))
                    size += len(block[-1])
                    done += 1
                    words = words_of(column[done].as_py()) if done < len(column) else []
                found = runs_in(block, least, exponent)
                part = batch.slice(first, done - first)
                named = lambda r: r and dict(zip(("start", "length", "period"), r))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in keep), pa.array([len(w) for w in block], pa.int64()),
                     pa.array([[named(r) for r in rs] for rs in found], pa.list_(RUN)),
                     pa.array([named(strongest(rs)) for rs in found], RUN),
                     pa.array([b" ".join(collapse(w, rs)).decode() for w, rs in zip(block, found)], pa.string())],
                    names=[*keep, *added])

    return map_batches(out, run, ", ".join([*types, f"n_words bigint, runs array<{_RUN_SQL}>, best {_RUN_SQL}, collapsed string"]))


def looped(text: Column, doc_id: Column) -> Column:
    """The query's input: with h = crc32(doc_id) divisible by 10, every word
    from a on repeats the p words there; other texts stay (null: empty)."""
    whole = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(F.translate(whole, "\t\n\x0b\x0c\r", "     "), " "), "")
    h = F.crc32(doc_id.cast("string").cast("binary"))
    made = F.transform(F.array(F.struct(words.alias("w"), F.floor(h / 10).alias("g"))), lambda x: F.struct(
        x["w"].alias("w"), x["g"].alias("g"), F.size(x["w"]).cast("long").alias("n")))
    made = F.transform(made, lambda x: F.struct(x["w"].alias("w"), x["g"].alias("g"), x["n"].alias("n"),
                                                F.when(x["n"] > 0, x["g"] % x["n"]).alias("a")))
    made = F.transform(made, lambda x: F.struct(
        x["w"].alias("w"), x["a"].alias("a"), (1 + F.floor((x["n"] - x["a"]) / (3 + x["g"] % 8))).alias("p")))
    made = F.transform(made, lambda x: F.array_join(F.transform(x["w"], lambda w, i: F.when(
        i < x["a"], w).otherwise(F.get(x["w"], (x["a"] + (i - x["a"]) % x["p"]).cast("int")))), " "))
    return F.when(F.coalesce(h % 10 == 0, F.lit(False)), F.get(made, 0)).otherwise(whole)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = find_runs(docs.select("doc_id", looped(F.col("text"), F.col("doc_id")).alias("text")), keep_text=False)
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"),
                                                   F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
