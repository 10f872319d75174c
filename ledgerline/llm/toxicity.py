"""Toxicity: a classifier regularised by counterfactuals.

A logistic model over the presence of words and word beginnings.  For every
labelled text that names a group, a second text is made in which each such
term is swapped for another of its kind; the loss penalises the squared
change of score between the two, so that naming a group moves no score by
itself.

Fitting: at most ``sample`` labelled rows of the training folds are used (the
rows with the smallest hash of their id, all of them if there are fewer);
this bound is what makes broadcasting their ids safe.  Features are counted
by label in Spark, the ``n_features`` with the clearest difference are kept,
and the model is fitted on the driver from the sample's kept features alone.
Scoring covers every whole text, in Arrow batches without a shuffle; the
model sent to the tasks is bounded by ``n_features``.

Inputs of a score are the text alone; labels, language, source and id are
not.  Rows whose crc32(doc_id as text) mod 3 is 1 are never learnt from.

Defined results: null text scores like an empty one (the model's prior); a
null id counts as an empty string in the fold's checksum; without labelled
rows of both kinds the score is the smoothed prior; repeated labels of an id
are toxic if one is; repeated documents each get a score; other columns are
kept unless their names clash with added ones.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordCache, bound_batches, map_batches, stored, table

SAMPLE, FEATURES, THRESHOLD = 20_000, 5_000, 0.7
LEAST_ROWS, LEAST_Z = 3, 4.0
RIDGE, FAIRNESS, STEPS = 1e-5, 1.0, 300
PREFIXES = (3, 4, 5)

#: Terms that name groups of people, by kind; any one may stand for another.
GROUPS = [
    ["women", "men", "girls", "boys"], ["woman", "man", "girl", "boy"], ["she", "he"], ["female", "male"],
    ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "atheists"],
    ["black", "white", "asian", "latino", "hispanic"], ["gay", "straight", "lesbian", "bisexual", "transgender"],
    ["immigrants", "refugees", "foreigners", "citizens"], ["african", "european", "american", "chinese", "mexican"],
    ["old", "young", "elderly"], ["deaf", "blind", "disabled"],
    ["frauen", "männer"], ["muslime", "christen", "juden"], ["ausländer", "flüchtlinge", "einwanderer"],
    ["femmes", "hommes"], ["musulmans", "chrétiens", "juifs"], ["immigrés", "réfugiés", "étrangers"],
    ["mujeres", "hombres"], ["musulmanes", "cristianos", "judíos"], ["inmigrantes", "refugiados", "extranjeros"],
]
SWAP = {t: g[(k + 1) % len(g)] for g in GROUPS for k, t in enumerate(g)}

_words = re.compile(r"[^\W\d_]+").findall


def held_out(doc_id: str) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(3)) == 1


def features_of(token: str) -> tuple[int, ...]:
    """Hashed features of a blank-separated token: its words, and their
    beginnings."""
    out = []
    for w in _words(token):
        out.append(crc32(b"=" + w.encode()))
        out += [crc32(b"^" + w[:k].encode()) for k in PREFIXES if len(w) > k]
    return tuple(out)


def text_features(text: str | None, of) -> set[int]:
    """Distinct features of a text; ``of`` gives those of one token."""
    out: set[int] = set()
    for f in map(of, set(text.lower().split()) if text else ()):
        out.update(f)
    return out


def swapped(text: str | None) -> str | None:
    """The text with each group term replaced, or None if it has none."""
    low = text.lower() if text else ""
    changed = re.sub(r"[^\W\d_]+", lambda m: SWAP.get(m[0], m[0]), low)
    return changed if changed != low else None


@dataclass
class Model:
    prior: float = 0.0
    weights: dict[int, float] = field(default_factory=dict)

    def score(self, features: set[int]) -> float:
        z = self.prior + sum(map(self.weights.__getitem__, sorted(features.intersection(self.weights))))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(text, toxic) of the labelled sample, stored."""
    known = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
             .select(F.col("doc_id").alias("l_id"), "toxic"))
    # the side is bounded by ``sample`` rows of two numbers
    rows = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("l_id"))
    return stored(rows.select("doc_id", "text", F.col("toxic").cast("int").alias("toxic")), "toxicity")


def _features_batch(batches):
    of = WordCache(features_of, 100_000).__getitem__
    for batch in batches:
        texts = batch.column("text").to_pylist()
        own = [sorted(text_features(t, of)) for t in texts]
        other = [None if (s := swapped(t)) is None else sorted(text_features(s, of)) for t in texts]
        kind = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(own, kind),
                                          pa.array(other, kind)], names=["doc_id", "toxic", "own", "other"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, n_features: int = FEATURES) -> Model:
    """The fitted model; what the driver gets is bounded by ``sample`` rows
    and ``n_features`` features."""
    rows = training_rows(docs, labels, sample)
    kind = rows.schema["doc_id"].dataType.simpleString()
    made = map_batches(rows, _features_batch, f"doc_id {kind}, toxic int, own array<bigint>, other array<bigint>")
    sizes = rows.agg(F.count("*").alias("n"), F.sum("toxic").alias("bad")).first()
    n, bad = sizes["n"], sizes["bad"] or 0
    prior = float(np.log((bad + 0.5) / (n - bad + 0.5))) if n else 0.0
    if not 0 < bad < n:
        return Model(prior)
    counts = made.select("toxic", F.explode("own").alias("f")).groupBy("f").agg(
        F.sum("toxic").alias("a"), F.count("*").alias("k"))
    # how far the feature's toxic rows are from their expected number, in standard deviations
    expected = F.col("k") * (bad / n)
    spread = F.sqrt(expected * (1 - bad / n) * (1 - F.col("k") / n) + 1e-9)
    best = (counts.where(F.col("k") >= LEAST_ROWS)
            .withColumn("z", (F.col("a") - expected) / spread).where(F.abs("z") >= LEAST_Z)
            .orderBy(F.abs("z").desc(), "f").limit(n_features))
    chosen = sorted(r["f"] for r in best.select("f").collect())
    if not chosen:
        return Model(prior)
    index = {f: k for k, f in enumerate(chosen)}
    wanted = docs.sparkSession.sparkContext.broadcast(index)

    def narrow(batches):
        get = wanted.value.get
        short = lambda fs: None if fs is None else [k for f in fs if (k := get(f)) is not None]
        for batch in _features_batch(batches):
            made = [[short(x) for x in batch.column(c).to_pylist()] for c in ("own", "other")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("toxic"), *(pa.array(m, pa.list_(pa.int32())) for m in made)],
                names=["doc_id", "toxic", "own", "other"])

    got = map_batches(rows, narrow, f"doc_id {kind}, toxic int, own array<int>, other array<int>").orderBy(
        "doc_id", "toxic", "own").toPandas()
    weights, prior = descend(got["own"].tolist(), got["other"].tolist(), got["toxic"].to_numpy(float), len(chosen), prior)
    return Model(prior, {f: float(weights[k]) for f, k in index.items() if weights[k]})


def descend(own, other, toxic: np.ndarray, n_features: int, prior: float, fairness: float = FAIRNESS,
            ridge: float = RIDGE, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights that minimise mean log loss + ridge + ``fairness`` times the
    mean squared score change under swapped group terms (Adam, whole batch)."""
    def matrix(lists):
        size = np.array([len(x) if x is not None else 0 for x in lists], int)
        cols = np.concatenate([np.asarray(x, int) for x in lists if x is not None and len(x)] or [np.zeros(0, int)])
        return np.repeat(np.arange(len(lists)), size), cols

    rows, cols = matrix(own)
    pairs = np.array([k for k, x in enumerate(other) if x is not None], int)
    p_rows, p_cols = matrix([own[k] for k in pairs])
    q_rows, q_cols = matrix([other[k] for k in pairs])
    n, p = len(toxic), max(len(pairs), 1)
    w, b = np.zeros(n_features), prior
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for step in range(1, steps + 1):
        z = np.bincount(rows, w[cols], n) + b
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - toxic) / n
        grad = np.bincount(cols, error[rows], n_features) + ridge * w
        if len(pairs):
            gap = np.bincount(p_rows, w[p_cols], len(pairs)) - np.bincount(q_rows, w[q_cols], len(pairs))
            gap *= 2 * fairness / p
            grad += np.bincount(p_cols, gap[p_rows], n_features) - np.bincount(q_cols, gap[q_rows], n_features)
        g = np.append(grad, error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.05 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return np.round(w, 6), float(round(b, 6))


def score(docs: DataFrame, model: Model, text: str = "text", keep_text: bool = True,
          threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` plus ``score`` and ``predicted``."""
    added = ("score", "predicted")
    rows = docs.drop(*[c for c in added if c != text])
    kept = [f for f in rows.schema.fields if f.name not in added and (keep_text or f.name != text)]
    names = [f.name for f in kept]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "score double"])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = sent.value
        of = WordCache(lambda t: tuple(f for f in features_of(t) if f in model.weights), 200_000).__getitem__
        for batch in batches:
            scores = [model.score(text_features(t.as_py(), of)) for t in batch.column(text)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(scores, pa.float64())],
                                             names=[*names, "score"])

    return map_batches(rows, run, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def score_column(text: Column, model: Model, spark: SparkSession) -> Column:
    """The score of a text column as a column: only texts go to the workers
    and only numbers come back, rows stay where they are."""
    bound_batches(spark)
    sent, held = spark.sparkContext.broadcast(model), []

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        if not held:
            WordCache.empty_others(features_of.__module__)
            known = sent.value.weights
            held.append(WordCache(lambda t: tuple(f for f in features_of(t) if f in known), 100_000).__getitem__)
        return pa.array([sent.value.score(text_features(t.as_py(), held[0])) for t in texts], pa.float64())

    return scored(text)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs.withColumn("held_out", held_out("doc_id")), model, keep_text=False)
