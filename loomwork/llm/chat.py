r"""Chat formatting whose text parses back to exactly the turns it was made from.

Grammar of a formatted conversation::

    conversation = turn*
    turn = "<s>[INST] " text " [/INST]"                 user
         | "<s><<SYS>>\n" text "\n<</SYS>>"             system
         | " " text " </s>"                             assistant
         | "<s>[ROLE]" role "[/ROLE] " text " </s>"     any other role

A text may hold none of the control strings. Where it does, backslashes make
the difference: a control string, also one with backslashes after its first
character already, gets one backslash more there, and the parser takes one
away, so the two are inverse to each other. A conversation is first rendered as
it is, parsed, and compared with its source; where that differs, or a control
string is left inside a text, it is rendered with escapes and checked again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import table

_REST = r"(/?s>|</?SYS>>|/?INST\]|/?ROLE\])"
ESCAPE = r"([<\[])(\\*)" + _REST
UNESCAPE = r"([<\[])\\(\\*)" + _REST
TURN = r"\G(?:<s>\[INST\] (?s:.*?) \[/INST\]|<s><<SYS>>\n(?s:.*?)\n<</SYS>>|<s>\[ROLE\](?s:.*?)\[/ROLE\] (?s:.*?) </s>| (?s:.*?) </s>)"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPE, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, UNESCAPE, "$1$2$3")


def render(role: Column, text: Column) -> Column:
    """One turn in the template; role and text as they shall stand there."""
    return (
        F.when(role == "user", F.concat(F.lit("<s>[INST] "), text, F.lit(" [/INST]")))
        .when(role == "system", F.concat(F.lit("<s><<SYS>>\n"), text, F.lit("\n<</SYS>>")))
        .when(role == "assistant", F.concat(F.lit(" "), text, F.lit(" </s>")))
        .otherwise(F.concat(F.lit("<s>[ROLE]"), role, F.lit("[/ROLE] "), text, F.lit(" </s>")))
    )


def parse(formatted: Column) -> Column:
    """The turns, as structs of role and text, of the longest parsable beginning."""

    def turn(s: Column) -> Column:
        def inner(before: int, after: int) -> Column:
            return F.substring(s, F.lit(before + 1), F.char_length(s) - before - after)

        named = F.substring(s, F.lit(10), F.char_length(s))
        role = F.regexp_extract(named, r"^((?s:.*?))\[/ROLE\] ", 1)
        body = F.substring(named, F.char_length(role) + 9, F.char_length(named) - F.char_length(role) - 13)
        return (
            F.when(s.startswith("<s>[INST] "), F.struct(F.lit("user").alias("role"), unescape(inner(10, 8)).alias("text")))
            .when(s.startswith("<s><<SYS>>\n"), F.struct(F.lit("system").alias("role"), unescape(inner(11, 9)).alias("text")))
            .when(s.startswith("<s>[ROLE]"), F.struct(unescape(role).alias("role"), unescape(body).alias("text")))
            .otherwise(F.struct(F.lit("assistant").alias("role"), unescape(inner(1, 5)).alias("text")))
        )

    return F.transform(F.regexp_extract_all(formatted, F.lit(TURN), F.lit(0)), turn)


def format_conversations(turns: DataFrame) -> DataFrame:
    """Per conv_id: source and parsed (arrays of role and text, in order), formatted, escaped (whether that was needed).

    Turns stand by turn (nulls first), then role, then text, so ties and
    repeated rows have one order and all of them stay. Null roles and texts
    count as empty; a null conv_id is a conversation of its own. Empty texts are
    turns like others. A conversation becomes one text, so it is gathered whole,
    whatever its length; all of a conversation's turns are its result. Other
    columns are ignored; an empty table gives no rows. A text that wouldn't
    parse back raises an error.
    """
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    gathered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    source = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    plain = F.array_join(F.transform("source", lambda t: render(t["role"], t["text"])), "")
    safe = F.array_join(F.transform("source", lambda t: render(escape(t["role"]), escape(t["text"]))), "")
    left = F.exists("source", lambda t: t["text"].rlike(ESCAPE) | t["role"].rlike(ESCAPE))
    first = gathered.select("conv_id", source.alias("source")).withColumn("plain", plain)
    first = first.withColumn("escaped", left | (parse(F.col("plain")) != F.col("source")))
    done = first.withColumn("formatted", F.when(F.col("escaped"), safe).otherwise(F.col("plain"))).drop("plain")
    done = done.withColumn("parsed", parse(F.col("formatted")))
    wrong = F.raise_error(F.concat(F.lit("doesn't parse back: conversation "), F.col("conv_id").cast("string")))
    return done.withColumn("parsed", F.when(F.col("parsed") == F.col("source"), F.col("parsed")).otherwise(wrong))


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted texts hold, read back from them."""
    told = F.array_join(F.transform("parsed", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("parsed", lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")
    return formatted.withColumn("loss", loss).select(
        "conv_id",
        F.size("parsed").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    more = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(text).alias("text")) for k, r in enumerate(("user", "assistant"))])).alias("t"))
    return digests(format_conversations(turns.unionByName(more.select("conv_id", "t.*"))))


OP5_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), shaped AS (
  SELECT *, length(regexp_replace(text, '([<\[])(\\*)(/?s>|</?SYS>>|/?INST\]|/?ROLE\])', '\1\\\2\3', 'g'))
    + CASE role WHEN 'user' THEN 18 WHEN 'system' THEN 20 WHEN 'assistant' THEN 6
      ELSE 22 + length(regexp_replace(role, '([<\[])(\\*)(/?s>|</?SYS>>|/?INST\]|/?ROLE\])', '\1\\\2\3', 'g')) END AS chars
  FROM turns
), gathered AS (
  SELECT conv_id, count(*) AS n_turns, sum(chars) AS chars,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS told,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss
  FROM shaped GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(told) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(chars AS BIGINT) AS formatted_chars
FROM gathered
"""
