"""Chat formatting: conversations to budgeted, turn-aligned training windows.

Every turn is rendered as ``<|im_start|>role\\n text <|im_end|>\\n`` (no
blanks).  Control strings inside texts are broken by ``\\!`` after their
first character, and backslashes are doubled, so that a text can never end
its own turn and unescaping gives it back.  A role that isn't a plain word is
written as ``=`` and its UTF-8 bytes in hex.

Windows: the running sum of turn tokens cuts a conversation's line of tokens
into buckets of ``room`` tokens (the budget less the system turn and the
history).  Turns that lie wholly inside a bucket form a window, a turn that
crosses a border forms its own; so no turn is cut and a window is over the
budget only if a single turn is.  Each window but the first repeats the
system turn (the conversation's first turn, if its role is ``system``) and
the turns among the last ``history`` tokens of the window before.  The loss
mask covers assistant texts of a window's own turns and never repeated ones:
each assistant text is a target exactly once.

Size: sums are taken in two levels (turn blocks, then offsets per block), so
one very long conversation is spread over tasks; nothing but a window's own
rows is ever gathered.  Only the registered query's digests need a whole
conversation in a row.

Defined results: null text is empty, null role is empty, a null ``conv_id``
is one conversation, a null ``turn`` sorts first; equal turns are ordered by
role and text and all kept; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

START, END = "<|im_start|>", "<|im_end|>\n"
#: Control strings that texts must not contain: this template's and others'.
CONTROL = ["<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
BUDGET, HISTORY, LEAST_ROOM, BLOCK = 2048, 256, 512, 1024
#: Tokens that a turn's marks take.
MARKS = 6


def escape(text: Column, control=CONTROL) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in control:
        out = F.replace(out, F.lit(c), F.lit(f"{c[0]}\\!{c[1:]}"))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(?:(\\)|!)", "$1")


def escape_role(role: Column) -> Column:
    return F.when(role.rlike(r"^[A-Za-z0-9_.-]+$") & ~role.contains("\n"), role).otherwise(
        F.concat(F.lit("="), F.hex(F.encode(role, "utf-8"))))


def unescape_role(role: Column) -> Column:
    return F.when(role.startswith("="), F.decode(F.unhex(F.substr(role, F.lit(2))), "utf-8")).otherwise(role)


def count_tokens(text: Column) -> Column:
    """Token estimate: a token for every four UTF-8 bytes, rounded up."""
    return F.floor((F.octet_length(text) + 3) / 4).cast("long")


def format_windows(conv: DataFrame, tokens=count_tokens, budget: int = BUDGET, history: int = HISTORY,
                   least_room: int = LEAST_ROOM, block: int = BLOCK) -> DataFrame:
    """(conv_id, window, text, loss, new_from): ``window`` orders a
    conversation's windows, ``loss`` lists code-point ranges (``from``,
    ``to``) of ``text`` that are targets, and own turns begin at
    ``new_from``."""
    turns = conv.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"))
    turns = turns.withColumn("tok", tokens(F.col("text")) + MARKS).withColumn(
        "block", F.floor(F.col("turn") / block))
    order = ["turn", "role", "text"]

    # level 1: tokens and first turn of each block; level 2: offsets over the blocks of a conversation
    by_conv = Window.partitionBy("conv_id").orderBy("block")
    blocks = turns.groupBy("conv_id", "block").agg(
        F.sum("tok").alias("b_tok"), F.min(F.struct(*order, "tok")).alias("first"))
    lead_turn = F.first("first").over(by_conv.rowsBetween(Window.unboundedPreceding, 0))
    blocks = blocks.select(
        F.col("conv_id").alias("b_conv"), F.col("block").alias("b_block"), "b_tok",
        F.coalesce(F.sum("b_tok").over(by_conv.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.lead("first.tok").over(by_conv).alias("next_tok"),
        F.when(lead_turn["role"] == "system", lead_turn["tok"]).otherwise(F.lit(0)).alias("sys_tok"),
        (F.row_number().over(by_conv) == 1).alias("is_first"), F.col("first.text").alias("sys_text"))
    system = blocks.where("is_first AND sys_tok > 0").select(
        F.col("b_conv").alias("s_conv"), F.struct(
            F.lit(-1).cast("long").alias("at"), F.lit(True).alias("again"), F.lit("system").alias("role"),
            escape(F.col("sys_text")).alias("body")).alias("system"))

    turns = turns.join(blocks.drop("sys_text", "is_first"),
                       F.col("conv_id").eqNullSafe(F.col("b_conv")) & F.col("block").eqNullSafe(F.col("b_block")))
    by_block = Window.partitionBy("b_conv", "b_block").orderBy(*order)
    room = F.greatest(F.lit(least_room).cast("long"), budget - history - F.col("sys_tok"))
    turns = turns.withColumn("room", room).withColumn(
        "at", F.col("before") - F.col("sys_tok") + F.coalesce(
            F.sum("tok").over(by_block.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))

    def span_of(at: Column, tok: Column) -> Column:
        first, last = F.floor(at / F.col("room")), F.floor((at + tok - 1) / F.col("room"))
        return 2 * first + (last > first).cast("long")

    own = F.when(F.col("at") >= 0, span_of(F.col("at"), F.col("tok")))  # null: the system turn
    after = F.col("before") - F.col("sys_tok") + F.col("b_tok")
    turns = turns.withColumn("own", own).withColumn("following", F.coalesce(
        F.lead("own").over(by_block), F.when(F.col("next_tok").isNotNull(), span_of(after, F.col("next_tok")))))
    turns = turns.withColumn("own", F.coalesce("own", "following", F.lit(0)))

    in_span = Window.partitionBy("b_conv", "own")
    turns = turns.withColumn("next_span", F.max("following").over(in_span)).withColumn(
        "span_end", F.max(F.col("at") + F.col("tok")).over(in_span))
    repeated = ((F.col("next_span") > F.col("own")) & (F.col("at") >= F.col("span_end") - history)
                & (F.col("at") >= 0))
    to = lambda span, again: F.struct(span.alias("window"), F.lit(again).alias("again"))
    placed = turns.select(
        F.col("b_conv").alias("conv_id"), "at", escape_role(F.col("role")).alias("role"),
        escape(F.col("text")).alias("body"),
        F.explode(F.array_compact(F.array(to(F.col("own"), False), F.when(
            repeated, to(F.col("next_span"), True))))).alias("to"))
    windows = placed.groupBy("conv_id", F.col("to.window").alias("window")).agg(
        F.sort_array(F.collect_list(F.struct("at", F.col("to.again").alias("again"), "role", "body"))).alias("pieces"))
    windows = windows.join(system, F.col("conv_id").eqNullSafe(F.col("s_conv")), "left").select(
        "conv_id", "window", F.when(F.col("system").isNotNull() & (F.col("pieces")[0]["at"] >= 0),
                                    F.concat(F.array("system"), F.col("pieces")))
        .otherwise(F.col("pieces")).alias("pieces"))

    opening = lambda p: F.concat(F.lit(START), p["role"], F.lit("\n"))
    sized = windows.select("conv_id", "window", "pieces", F.transform(
        "pieces", lambda p: F.length(opening(p)) + F.length(p["body"]) + len(END)).alias("sizes"))
    sized = sized.select("*", F.aggregate("sizes", F.array(F.lit(0)), lambda acc, n: F.concat(
        acc, F.array(F.element_at(acc, -1) + n))).alias("from"))
    loss = F.filter(F.transform("pieces", lambda p, i: F.when(
        (p["role"] == "assistant") & ~p["again"], F.struct(
            (F.get("from", i) + F.length(opening(p))).alias("from"),
            (F.get("from", i + 1) - len(END)).alias("to")))), lambda x: x.isNotNull())
    repeats = F.size(F.filter("pieces", lambda p: p["again"]))
    return sized.select(
        "conv_id", "window",
        F.array_join(F.transform("pieces", lambda p: F.concat(opening(p), p["body"], F.lit(END))), "").alias("text"),
        loss.alias("loss"), F.get("from", repeats).alias("new_from"))


def read_back(windows: DataFrame) -> DataFrame:
    """Turns and targets parsed out of formatted windows: (conv_id, window,
    turns array<struct<role, text>> of the window's own turns, targets)."""
    own = F.substr("text", F.col("new_from") + 1)
    pieces = F.filter(F.split(own, r"<\|im_end\|>\n"), lambda p: p != "")
    turn = lambda p: F.struct(
        unescape_role(F.substr(F.call_function("substring_index", p, F.lit("\n"), F.lit(1)), F.lit(len(START) + 1))).alias("role"),
        unescape(F.substr(p, F.instr(p, "\n") + 1)).alias("text"))
    return windows.select("conv_id", "window", F.length("text").alias("chars"),
                          F.transform(pieces, turn).alias("turns"),
                          F.transform("loss", lambda x: unescape(F.substr("text", x["from"] + 1, x["to"] - x["from"])))
                          .alias("targets"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"""SELECT -1L AS conv_id, col1 AS turn, col2 AS role, '{own}' AS text
        FROM VALUES (0L, 'user'), (1L, 'assistant')""")
    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    back = read_back(format_windows(conv)).select(
        "conv_id", "window", "chars", F.size("turns").alias("n"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
        .alias("said"), F.array_join("targets", "").alias("target"))
    whole = back.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"),
        F.sort_array(F.collect_list(F.struct("window", "said", "target"))).alias("parts"))
    return whole.select(
        "conv_id", F.col("n_turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join("parts.said", ""), 256).alias("turns_sha256"),
        F.length(F.array_join("parts.target", "")).cast("long").alias("loss_chars"),
        F.sha2(F.array_join("parts.target", ""), 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"))


def _sql() -> str:
    esc = "replace(text, '\\', '\\\\')"
    for c in CONTROL:
        esc = f"replace({esc}, '{c}', '{c[0]}\\!{c[1:]}')"
    return f"""
WITH s AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
a AS (SELECT *, (strlen(text) + 3) // 4 + {MARKS} AS tok,
  {len(START) + 1 + len(END)} + length(CASE WHEN regexp_full_match(role, '[A-Za-z0-9_.-]+') THEN role ELSE '=' || hex(encode(role)) END)
    + length({esc}) AS n,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS rn FROM s),
b AS (SELECT *, first_value(CASE WHEN role = 'system' THEN tok ELSE 0 END) OVER w AS st,
  first_value(CASE WHEN role = 'system' THEN n ELSE 0 END) OVER w AS sn, sum(tok) OVER w - tok AS cum
  FROM a WINDOW w AS (PARTITION BY conv_id ORDER BY rn)),
c AS (SELECT *, cum - st AS p, greatest({LEAST_ROOM}, {BUDGET - HISTORY} - st) AS room FROM b),
d AS (SELECT *, CASE WHEN p >= 0 THEN 2 * (p // room) + CASE WHEN (p + tok - 1) // room > p // room THEN 1 ELSE 0 END END AS span0 FROM c),
e AS (SELECT *, coalesce(span0, lead(span0) OVER (PARTITION BY conv_id ORDER BY rn), 0) AS span,
  lead(span0) OVER (PARTITION BY conv_id ORDER BY rn) AS following FROM d),
f AS (SELECT *, max(following) OVER (PARTITION BY conv_id, span) AS nxt, max(p + tok) OVER (PARTITION BY conv_id, span) AS stop FROM e)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY rn)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS bigint) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY rn), '')) AS loss_sha256,
  CAST(sum(n) + sum(CASE WHEN nxt > span AND p >= stop - {HISTORY} AND p >= 0 THEN n ELSE 0 END)
    + max(sn) * (count(DISTINCT span) - 1) AS bigint) AS formatted_chars
FROM f GROUP BY conv_id"""


SQL = _sql()
