"""URL filters: host-suffix and path-prefix expressions matched by an
equi-join on short hash prefixes, confirmed on the full digest.

Each url gives its host's suffixes at label borders and, for each, its
path's prefixes that end at ``/``.  An expression is ``suffix + prefix``; a
rule is filed under its own host plus its path up to the last ``/``.  The
join key is the first 8 hex digits of the expression's SHA-256; a match
counts when the full digests are equal and the url's path starts with the
rule's whole path.  The longest matching rule (host + path; then the longer
host, then block before allow) decides; without one, ``default`` does.

Size: expressions are made for distinct (host, path) pairs only, and only as
many labels and path levels as the rules themselves have (two numbers from
the rule table), so a long url gives few rows.  The winner per (host, path)
is a partially aggregated maximum.  Joins are left to the optimiser: a rule
table under the broadcast threshold is broadcast, a larger one is shuffled,
and skewed keys of the joins back to the pages are split by AQE.

Defined results: a null url, or one without ``://``, has empty host and path
and takes the default verdict; an empty path matches no rule path; repeated
pages each get a row; an empty table gives an empty one; very long urls give
no more expressions than the rules have labels and levels; other columns are
kept, whatever their names, but those named like an added column are replaced;
rules with a null host, path or verdict raise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, set_aside, table

#: (host, path, verdict) of the registered query.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
SHORT = 8


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))
    host = ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_table(spark: SparkSession, rules) -> DataFrame:
    """Rules as a table with their expression's digests."""
    df = rules if isinstance(rules, DataFrame) else spark.createDataFrame(
        list(rules), "host string, path string, verdict string")
    need = lambda c: F.coalesce(F.col(c), F.raise_error(F.lit(f"a rule has no {c}")))
    df = df.select(ascii_lower(need("host")).alias("r_host"), need("path").alias("r_path"),
                   need("verdict").alias("r_verdict"))
    anchor = F.regexp_extract("r_path", r"^(?s:.*/)?", 0)
    return (df.distinct()
            .withColumn("r_digest", F.sha2(F.concat("r_host", anchor), 256))
            .withColumn("r_short", F.substring("r_digest", 1, SHORT)))


def filter_urls(pages: DataFrame, rules, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` plus ``host``, ``path``, ``rule`` and ``verdict``."""
    spark = pages.sparkSession
    pages, there, back = set_aside(pages, ("won", "w_host", "w_path"))
    url = there.get(url, url)
    rt = rule_table(spark, rules)
    depth = rt.agg(F.max(F.size(F.split("r_host", r"\."))).alias("labels"),
                   F.max(F.size(F.split("r_path", "/"))).alias("levels")).first()
    labels, levels = depth["labels"] or 0, depth["levels"] or 0
    host, path = url_parts(F.col(url))
    keep = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    rows = pages.select(*keep, host.alias("host"), path.alias("path"))

    parts = F.split("host", r"\.")
    n = F.size(parts)
    # the last 1..labels labels of the host, longest host suffixes of the rules only
    suffixes = F.transform(F.sequence(F.lit(1), F.least(n, F.lit(max(labels, 1)))),
                           lambda k: F.call_function("substring_index", F.col("host"), F.lit("."), -k))
    steps = F.size(F.split("path", "/")) - 1
    prefixes = F.concat(F.array(F.lit("")), F.when(
        steps > 0, F.transform(F.sequence(F.lit(1), F.least(steps, F.lit(max(levels, 1)))),
                               lambda k: F.concat(F.call_function("substring_index", F.col("path"), F.lit("/"), k),
                                                          F.lit("/"))))
        .otherwise(F.array().cast("array<string>")))
    asked = (rows.select("host", "path").distinct()
             .withColumn("suffix", F.explode(suffixes))
             .withColumn("prefix", F.explode(prefixes))
             .withColumn("digest", F.sha2(F.concat("suffix", "prefix"), 256))
             .withColumn("short", F.substring("digest", 1, SHORT)))
    hits = (asked.join(rt, F.col("short") == F.col("r_short"))
            .where((F.col("digest") == F.col("r_digest")) & (F.col("suffix") == F.col("r_host"))
                   & F.col("path").startswith(F.col("r_path"))))
    rank = F.struct(F.length(F.concat("r_host", "r_path")).alias("n"), F.length("r_host").alias("h"),
                    F.col("r_verdict").alias("verdict"), F.concat("r_host", "r_path").alias("rule"))
    won = (hits.groupBy(F.col("host").alias("w_host"), F.col("path").alias("w_path"))
           .agg(F.max(rank).alias("won")))
    return (rows.join(won, (F.col("host") == F.col("w_host")) & (F.col("path") == F.col("w_path")), "left")
            .select(*keep, "host", "path", F.col("won.rule").alias("rule"),
                    F.coalesce("won.verdict", F.lit(default)).alias("verdict")).withColumnsRenamed(back))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), RULES).select(
        "page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    cond = lambda h, p: (f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))")
    ordered = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    case = lambda what: "CASE " + " ".join(
        f"WHEN {cond(h, p)} THEN '{what(h, p, v)}'" for h, p, v in ordered)
    return f"""
WITH r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{'ABCDEFGHIJKLMNOPQRSTUVWXYZ'}', '{'abcdefghijklmnopqrstuvwxyz'}') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r)
SELECT page_id, host, path, {case(lambda h, p, v: h + p)} END AS rule, {case(lambda h, p, v: v)} ELSE 'allow' END AS verdict FROM p"""


SQL = _sql()
