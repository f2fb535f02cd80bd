"""Chat formatting: turns become one training string whose grammar reads back to the very same turns.

Main path in DataFrame functions only. The template is

    user        <s>[INST] text [/INST]
    assistant   <s> text </s>
    any other   <s>[ROLE] role [/ROLE] text </s>

and six control strings: <s> </s> [INST] [/INST] [ROLE] [/ROLE]. A control string right after a backslash is
content. Every conversation is rendered as it is, reparsed with a strict parser and compared with its source; where
that differs, its roles and texts are escaped (a backslash before every control string, on top of any that stand
there) and the round trip is made again. Escaping always ends in identity: it changes only what stands before a
control string, unescaping takes that one backslash away, and the template puts a space between content and its own
control strings. A conversation that still differed would raise an error rather than pass.

Defined results: null text or role counts as empty; turns sort by (turn, role, text), nulls first, and repeated
rows are repeated turns; all rows with a null conversation id form one conversation; an empty table gives an empty
result; other columns are ignored whatever their names. A conversation is one output row, so its size is bounded by
Spark's largest string (2 GB).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagmill.llm.common import let

CONTROL = r"</?s>|\[/?(?:INST|ROLE)\]"
LIVE = rf"(?<!\\)(?:{CONTROL})"
ROUNDS = 2


def escape(text: Column) -> Column:
    return F.regexp_replace(text, f"({CONTROL})", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"\\({CONTROL})", "$1")


def render(turns: Column) -> Column:
    """turns: array of (role, text), neither null."""

    def one(t: Column) -> Column:
        return (
            F.when(t.role == "user", F.concat(F.lit("<s>[INST] "), t.text, F.lit(" [/INST]")))
            .when(t.role == "assistant", F.concat(F.lit("<s> "), t.text, F.lit(" </s>")))
            .otherwise(F.concat(F.lit("<s>[ROLE] "), t.role, F.lit(" [/ROLE] "), t.text, F.lit(" </s>")))
        )

    return F.array_join(F.transform(turns, one), "")


def parse(formatted: Column) -> Column:
    """Array of (role, text), unescaped; role and text are null in a turn that isn't in the grammar."""

    def between(s: Column, head: int, tail: int) -> Column:
        return F.substring(s, F.lit(head + 1), F.length(s) - F.lit(head + tail))

    def turn(role: Column, text: Column) -> Column:
        return F.when(~text.rlike(LIVE) & ~role.rlike(LIVE), F.struct(unescape(role).alias("role"), unescape(text).alias("text")))

    def other(s: Column) -> Column:
        def cut(rest: Column) -> Column:
            role = F.substring_index(rest, " [/ROLE] ", 1)
            return F.when(F.contains(rest, F.lit(" [/ROLE] ")), turn(role, F.substring(rest, F.length(role) + 10, F.length(rest))))

        return let(between(s, 7, 5), cut)

    def one(s: Column) -> Column:
        return (
            F.when(s.startswith("[INST] ") & s.endswith(" [/INST]") & (F.length(s) >= 15), turn(F.lit("user"), between(s, 7, 8)))
            .when(s.startswith("[ROLE] ") & s.endswith(" </s>") & (F.length(s) >= 12), other(s))
            .when(s.startswith(" ") & s.endswith(" </s>") & (F.length(s) >= 6), turn(F.lit("assistant"), between(s, 1, 5)))
        )

    parts = F.split(formatted, r"(?<!\\)<s>", -1)
    return let(parts, lambda p: F.when(F.element_at(p, 1) == "", F.transform(F.slice(p, 2, F.size(p)), one)))


def round_trip(turns: Column) -> Column:
    """(formatted, recovered, level): level is how often the conversation had to be escaped."""

    def attempt(source: Column, level: int) -> Column:
        def judged(made: Column) -> Column:
            back = let(parse(made), lambda got: F.struct(made.alias("formatted"), got.alias("recovered"), F.lit(level).alias("level")))
            again = (
                F.raise_error(F.lit("a conversation can't be read back from its format")).cast("struct<formatted:string,recovered:array<struct<role:string,text:string>>,level:int>")
                if level + 1 == ROUNDS
                else let(F.transform(source, lambda t: F.struct(escape(t.role).alias("role"), escape(t.text).alias("text"))), lambda e: attempt(e, level + 1))
            )
            return let(back, lambda b: F.when(F.coalesce(b.recovered == turns, F.lit(False)), b).otherwise(again))

        return let(render(source), judged)

    return attempt(turns, 0)


def format_conversations(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, formatted, recovered (array of role and text, read back from formatted), level: a row per conversation."""
    rows = df.select(
        df[conv].alias("conv_id"),
        F.struct(df[turn].alias("turn"), F.coalesce(df[role].cast("string"), F.lit("")).alias("role"), F.coalesce(df[text].cast("string"), F.lit("")).alias("text")).alias("row"),
    )
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    turns = F.transform("rows", lambda r: F.struct(r.role.alias("role"), r.text.alias("text")))
    return whole.select("conv_id", let(turns, round_trip).alias("made")).select("conv_id", "made.*")


def under_loss(recovered: Column) -> Column:
    """The text that the loss covers: each assistant text once, in order, nothing between."""
    return F.array_join(F.transform(F.filter(recovered, lambda t: t.role == "assistant"), lambda t: t.text), "")


def digests(formatted: DataFrame) -> DataFrame:
    hashed = F.array_join(F.transform("recovered", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    loss = let(under_loss(F.col("recovered")), lambda s: F.struct(F.length(s).cast("long").alias("chars"), F.sha2(s, 256).alias("hash")))
    return formatted.select(
        "conv_id", F.size("recovered").cast("long").alias("n_turns"), F.sha2(hashed, 256).alias("turns_sha256"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars")
    ).select("conv_id", "n_turns", "turns_sha256", F.col("loss.chars").alias("loss_chars"), F.col("loss.hash").alias("loss_sha256"), "formatted_chars")


def op1_chat_format(spark, sf_dir: str) -> DataFrame:
    from tagmill.llm.common import table

    made = F.lit("</s>[INST] ok [/INST]")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), made.alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return digests(format_conversations(rows))


OP1_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, length(text) + len(regexp_extract_all(text, '</?s>|\[/?(?:INST|ROLE)\]')) AS n,
    length(role) + len(regexp_extract_all(role, '</?s>|\[/?(?:INST|ROLE)\]')) AS r FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(CASE role WHEN 'user' THEN n + 18 WHEN 'assistant' THEN n + 9 ELSE n + r + 24 END) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
