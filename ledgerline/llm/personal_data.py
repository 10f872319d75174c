"""Personal data: spans found by patterns, weighed by labelers whose
reliabilities expectation-maximisation estimates, and kept by a classifier
trained on its verdicts.

*Base* spans (email, ip, card, phone) are exact patterns with a check each
and are always kept.  *Candidates* are all matches of the base patterns,
failing ones too, and of wider kinds (secrets, national id numbers, IBANs,
local phone numbers, written-out emails).  Four labelers vote on each
candidate for (1), against (-1) or not (0): the kind's form check, a
gazetteer, the words before it, and its shape.  Votes are counted over the
whole corpus by pattern; the counts, a few hundred rows at most, are all the
driver gets.  There EM fits a two-class model (labelers independent given the
class, a prior per kind), and a logistic classifier of votes and kind is
trained on its posteriors.  The classifier is compiled into one expression;
candidates of the wider kinds that it accepts are added to the base spans
unless they lie inside one.  Spans that overlap are masked as one.

Everything on the tables is DataFrame expressions: two passes over the texts
and one small aggregation, no other shuffle.  Offsets are code points, from
running sums of the lengths of matches and of the text between them.

Defined results: null text has no spans; repeated rows each get a result; an
empty table gives an empty one; other columns are kept, whatever their names,
but those named like an added column are replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import set_aside, table

BASE = ["email", "ip", "card", "phone"]
WIDER = ["secret", "ssn", "iban", "phone_local", "email_written"]
KINDS = BASE + WIDER
LABELERS = ["form", "gazetteer", "context", "shape"]
ACCEPT, CONTEXT, CHUNK = 0.5, 40, 128

#: Possessive, and begun only where a run begins (or the last match ended),
#: which finds the same matches in time linear in the text.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?i)(?<![a-z])(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key)[\"']?[\x20]?[:=][\x20]?"
              r"[\"']?[A-Za-z0-9+/_.~=-]{8,}+",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "phone_local": r"(?<![0-9+).-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9-])",
    "email_written": r"(?i)(?:\G|(?<![a-z0-9._%+-]))[a-z0-9._%+-]++\x20?[\[(]at[\])]\x20?[a-z0-9-]++"
                     r"(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[a-z0-9-]++)++",
}
#: A text without this can't match.
NEEDS = {
    "email": lambda t: t.contains("@"), "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9][\x20-]?[0-9]"), "phone": lambda t: t.rlike(r"\+[0-9]"),
    "secret": lambda t: t.contains("=") | t.contains(":"), "ssn": lambda t: t.rlike(r"[0-9]-[0-9]{2}-[0-9]"),
    "iban": lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}"), "phone_local": lambda t: t.rlike(r"[0-9]{3}[.-][0-9]{4}"),
    "email_written": lambda t: t.rlike(r"(?i)[\[(]at[\])]"),
}
_OCTET = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_DIGITS = lambda m: F.regexp_replace(m, "[^0-9]", "")
FORM = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"),
    "card": lambda m: F.length(_DIGITS(m)).between(14, 19) & F.call_function("luhn_check", _DIGITS(m)),
    "phone": lambda m: F.length(_DIGITS(m)).between(10, 15),
    "secret": lambda m: m.rlike(r"[A-Za-z0-9+/_-]{16,}[\"']?$"),
    "ssn": lambda m: ~m.rlike(r"^(?:000|666|9)|-00-|-0000$"),
    "iban": lambda m: F.length(F.replace(m, F.lit(" "), F.lit(""))).between(15, 34),
    "phone_local": lambda m: m.rlike(r"^\(?[2-9]"),
    "email_written": lambda m: F.lit(True),
}
#: Gazetteers: country codes, top-level domains, IBAN countries, card prefixes; reserved ip ranges speak against.
GAZETTEER = {
    "email": (r"(?i)\.(?:com|org|net|edu|gov|info|io|eu|de|fr|es|it|uk|us|at|ch|nl|be)$", None),
    "ip": (None, r"^(?:0|10|127|255)\.|^192\.168\.|^169\.254\."),
    "card": (r"^(?:4|5[1-5]|2[2-7]|3[47]|6)", r"^[01789]"),
    "phone": (r"^\+(?:1|7|20|27|3[0-9]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])", None),
    "secret": (r"(?i)^(?:token|secret|password|api|access)", r"(?i)(?:example|changeme|your_|xxxx|\*\*\*\*)"),
    "ssn": (None, r"^(?:123-45-6789|078-05-1120)$"),
    "iban": (r"^(?:AT|BE|CH|DE|DK|ES|FI|FR|GB|IE|IT|LU|NL|NO|PL|PT|SE)", None),
    "phone_local": (None, r"^\(?555"),
    "email_written": (r"(?i)(?:com|org|net|edu|gov|info|io|eu|de|fr|es)$", None),
}
CUES = {
    "email": "mail|contact|write|kontakt|courriel|correo|@", "ip": "ip|host|server|address|adresse|dirección",
    "card": "card|visa|mastercard|amex|karte|carte|tarjeta|credit",
    "phone": "call|phone|tel|mobile|fax|telefon|téléphone|teléfono|contact",
    "secret": "api|auth|config|login|key|export|bearer|=|\\(|\\{|,", "ssn": "ssn|social|security",
    "iban": "iban|account|konto|compte|cuenta|bank", "phone_local": "call|phone|tel|mobile|fax|telefon",
    "email_written": "mail|contact|write|kontakt|correo",
}
AGAINST = r"(?:version|release|licen[sc]e|isbn|page|order|section|chapter|art\.|no\.|nr\.)\W{0,3}$"


def running_sums(sizes: Column) -> Column:
    """Inclusive running sums of an int array, in blocks so that long arrays
    don't cost the square of their length."""
    def sums(xs, first):
        return F.slice(F.aggregate(xs, F.array(first), lambda acc, x: F.concat(
            acc, F.array(F.element_at(acc, -1) + x))), F.lit(2), F.greatest(F.size(xs), F.lit(1)))

    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(sizes) / CHUNK).cast("int") - 1, F.lit(0))),
                         lambda b: F.slice(sizes, b * CHUNK + 1, F.lit(CHUNK)))
    totals = lambda bs: F.concat(F.array(F.lit(0)), sums(F.transform(bs, lambda b: F.aggregate(
        b, F.lit(0), lambda a, x: a + x)), F.lit(0)))
    return F.flatten(F.transform(F.array(blocks), lambda bs: F.flatten(F.zip_with(
        bs, totals(bs), lambda b, t: F.when(b.isNotNull(), sums(b, t)).otherwise(F.array().cast("array<int>"))))))


#: Columns in between; an input's own columns of these names are set aside.
HELPERS = ("_t", "_c", "_more", "_done", *(f"_h{i}" for i in range(len(KINDS))), *(f"_s{i}" for i in range(len(KINDS))))


def _text_column(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("_t", F.coalesce(F.col(text), F.lit("")))


def find_candidates(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` plus ``candidates``: array of (start, kind, stop, votes), kind
    as its place in ``KINDS``."""
    df, there, back = set_aside(df, HELPERS)
    text = there.get(text, text)
    names = [c for c in df.columns if c != "candidates"]
    empty = F.array().cast("array<string>")
    t = F.col("_t")
    df = _text_column(df.select(*names), text).select(*names, "_t", *(
        F.when(NEEDS[k](t), F.regexp_extract_all(t, F.lit(p), F.lit(0))).otherwise(empty).alias(f"_h{i}")
        for i, (k, p) in enumerate(PATTERNS.items())))
    df = df.select(*names, "_t", *(f"_h{i}" for i in range(len(KINDS))), *(
        F.when(F.size(f"_h{i}") > 0, F.zip_with(
            F.transform(F.split(t, p, -1), F.length), F.transform(f"_h{i}", F.length),
            lambda gap, hit: gap + F.coalesce(hit, F.lit(0)))).alias(f"_s{i}") for i, p in enumerate(PATTERNS.values())))
    def placed(i: int) -> Column:
        ends = F.slice(running_sums(F.col(f"_s{i}")), F.lit(1), F.size(f"_h{i}"))
        at = lambda m, stop: F.struct((stop - F.length(m)).alias("start"), F.lit(i).alias("kind"),
                                      stop.alias("stop"), m.alias("m"))
        return F.when(F.size(f"_h{i}") > 0, F.zip_with(F.col(f"_h{i}"), ends, at)).otherwise(
            F.array().cast("array<struct<start:int,kind:int,stop:int,m:string>>"))

    found = [placed(i) for i in range(len(KINDS))]
    df = df.select(*names, "_t", F.concat(*found).alias("_c"))

    def voted(c):
        before = F.lower(F.substr(t, F.greatest(c["start"] - CONTEXT, F.lit(0)) + 1,
                                  F.least(c["start"], F.lit(CONTEXT))))
        by_kind = lambda votes: reduce(lambda w, iv: w.when(c["kind"] == iv[0], iv[1]),
                                       list(enumerate(votes))[1:], F.when(c["kind"] == 0, votes[0]))
        m = c["m"]
        vote = lambda yes, no: F.when(no, F.lit(-1)).when(yes, F.lit(1)).otherwise(F.lit(0))
        listed = lambda p: F.lit(False) if p is None else m.rlike(p)
        digits = F.size(F.array_distinct(F.split(_DIGITS(m), "")))
        signs = F.size(F.array_distinct(F.split(m, "")))
        return F.struct(
            c["start"].alias("start"), c["kind"].alias("kind"), c["stop"].alias("stop"),
            by_kind([F.when(FORM[k](m), F.lit(1)).otherwise(F.lit(-1)) for k in KINDS]).alias("form"),
            by_kind([vote(listed(GAZETTEER[k][0]), listed(GAZETTEER[k][1])) for k in KINDS]).alias("gazetteer"),
            vote(by_kind([before.rlike(f"(?:{CUES[k]})\\W{{0,12}}$") for k in KINDS]), before.rlike(AGAINST))
            .alias("context"),
            F.when(c["kind"] == KINDS.index("secret"), vote((signs >= 14) & m.rlike("[0-9]"), signs < 10))
            .otherwise(vote(digits >= 4, digits <= 2)).alias("shape"))

    return df.select(*names, F.transform("_c", voted).alias("candidates")).withColumnsRenamed(back)


@dataclass
class SpanModel:
    """``reliability[y][labeler][vote]`` from EM, and the classifier."""
    reliability: list
    bias: float
    by_kind: list[float]
    by_vote: dict[str, tuple[float, float]]

    def accepts(self, c: Column) -> Column:
        z = F.lit(self.bias) + F.element_at(F.array(*[F.lit(x) for x in self.by_kind]), c["kind"] + 1)
        for name, (no, yes) in self.by_vote.items():
            z = z + F.when(c[name] == 1, F.lit(yes)).when(c[name] == -1, F.lit(no)).otherwise(F.lit(0.0))
        return z >= math.log(ACCEPT / (1 - ACCEPT))


def fit(counts: list[tuple[int, tuple[int, ...], int]], rounds: int = 60) -> SpanModel:
    """From (kind, votes, how often): EM over the labelers, then the
    classifier on its posteriors."""
    kind = np.array([c[0] for c in counts], int)
    votes = np.array([c[1] for c in counts], int).reshape(len(counts), len(LABELERS)) + 1
    n = np.array([c[2] for c in counts], float)
    # belief before any count: a labeler is right more often than wrong
    belief = np.array([[[6.0, 3.0, 2.0]] * len(LABELERS), [[2.0, 3.0, 6.0]] * len(LABELERS)])
    chance, prior = belief / belief.sum(-1, keepdims=True), np.full(len(KINDS), 0.5)
    post = np.full(len(counts), 0.5)
    places = np.arange(len(LABELERS))
    for _ in range(rounds):
        log = np.log(chance[:, places, votes]).sum(-1)
        odds = log[1] - log[0] + np.log(prior[kind] / (1 - prior[kind]))
        post = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        for y, share in ((0, 1 - post), (1, post)):
            for j in places:
                chance[y, j] = belief[y, j] + np.bincount(votes[:, j], n * share, 3)
        chance /= chance.sum(-1, keepdims=True)
        prior = (2 + np.bincount(kind, n * post, len(KINDS))) / (4 + np.bincount(kind, n, len(KINDS)))
    # logistic regression on votes and kind, weighted by how often a pattern occurs
    x = np.hstack([np.ones((len(counts), 1)), np.eye(len(KINDS))[kind],
                   *[np.stack([votes[:, j] == 0, votes[:, j] == 2], 1) for j in places]]).astype(float)
    w, weight = np.zeros(x.shape[1]), n / max(n.sum(), 1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - post)) + 1e-4 * w
        curve = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + 1e-4 * np.eye(len(w))
        w -= np.clip(np.linalg.solve(curve, grad), -2, 2)
    w = np.round(w, 6).tolist()
    at = 1 + len(KINDS)
    return SpanModel(chance.round(6).tolist(), w[0], w[1:at],
                     {name: (w[at + 2 * j], w[at + 2 * j + 1]) for j, name in enumerate(LABELERS)})


def train(docs: DataFrame, text: str = "text") -> SpanModel:
    """The span model of a corpus; the driver gets one row per pattern of
    votes (9 kinds and 3 to the 4th patterns at most)."""
    seen = (find_candidates(docs.select(text), text).select(F.explode("candidates").alias("c"))
            .groupBy(F.col("c.kind").alias("kind"), *(F.col(f"c.{v}").alias(v) for v in LABELERS)).count())
    rows = sorted((r["kind"], tuple(r[v] for v in LABELERS), r["count"]) for r in seen.collect())
    return fit(rows)


def find_spans(docs: DataFrame, model: SpanModel, text: str = "text") -> DataFrame:
    """``docs`` plus ``base`` and ``spans``: arrays of (start, kind, stop) in
    order; ``spans`` holds the base ones and those that the model adds."""
    docs, there, back = set_aside(docs, (*HELPERS, "candidates"))
    text = there.get(text, text)
    names = [c for c in docs.columns if c not in ("base", "spans")]
    plain = lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["stop"].alias("stop"))
    df = find_candidates(docs.select(*names), text).select(
        *names, F.sort_array(F.transform(F.filter("candidates", lambda c: (c["kind"] < len(BASE)) & (c["form"] == 1)),
                                         plain)).alias("base"),
        F.transform(F.filter("candidates", lambda c: (c["kind"] >= len(BASE)) & model.accepts(c)), plain).alias("_more"))
    added = F.filter("_more", lambda c: ~F.exists("base", lambda b: (b["start"] <= c["start"]) & (c["stop"] <= b["stop"])))
    return df.select(*names, "base", F.sort_array(F.concat("base", added)).alias("spans")).withColumnsRenamed(back)


def written(spans) -> Column:
    """``kind:start:stop`` of each span, joined by commas."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def united(spans) -> Column:
    """Spans in order, those that overlap as one of the first's kind."""
    none = F.array().cast("array<struct<start:int,kind:int,stop:int>>")
    longer = lambda s, x: F.struct(s["start"].alias("start"), s["kind"].alias("kind"),
                                   F.greatest(s["stop"], x["stop"]).alias("stop"))
    open_ = F.struct(none.alias("out"), F.lit(None).cast("struct<start:int,kind:int,stop:int>").alias("last"))
    put = lambda s: F.when(s["last"].isNull(), s["out"]).otherwise(F.concat(s["out"], F.array(s["last"])))
    return F.aggregate(spans, open_, lambda s, x: F.when(
        x["start"] < s["last"]["stop"], F.struct(s["out"].alias("out"), longer(s["last"], x).alias("last"))).otherwise(
        F.struct(put(s).alias("out"), F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["stop"].alias("stop"))
                 .alias("last"))), put)


def redact(found: DataFrame, text: str = "text") -> DataFrame:
    """``found`` with each span in ``text`` replaced by its kind in angle
    brackets; spans that overlap are one, also in ``spans``."""
    found, there, back = set_aside(found, HELPERS)
    text = there.get(text, text)
    kinds = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    t = F.col(text)
    found = found.withColumn("spans", F.when(F.size("spans") > 1, united(F.col("spans"))).otherwise(F.col("spans")))
    # one span after another: what stands between, then the mark
    done = F.aggregate("spans", state, lambda s, x: F.struct(
        x["stop"].alias("at"), F.concat(s["out"], F.array(
            F.substr(t, s["at"] + 1, x["start"] - s["at"]), F.element_at(kinds, x["kind"] + 1))).alias("out")))
    names = [c for c in found.columns if c != "_done"]
    return found.select(*names, F.when(F.size("spans") > 0, done).alias("_done")).select(*[
        F.when(F.col("_done").isNotNull(), F.concat(F.array_join("_done.out", ""), F.substr(t, F.col("_done.at") + 1)))
        .otherwise(t).alias(text) if c == text else F.col(c) for c in names]).withColumnsRenamed(back)


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_spans(docs, train(docs))
    count = lambda k: F.size(F.filter("base", lambda b: b["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *(count(k) for k in BASE), F.sha2(written("base"), 256).alias("base_sha256"),
                        written("spans").alias("spans"))
