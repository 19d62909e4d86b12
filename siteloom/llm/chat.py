"""Chat formatting: every assistant turn becomes an example with all turns before it as context.

Native. A conversation is gathered once; its examples are made by slices of its formatted turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the template: what opens and closes a turn.
MARKS = {"system": ("[SYS] ", " [/SYS]"), "user": ("[INST] ", " [/INST]"), "assistant": ("[BOT] ", " </s>")}
OTHER_ROLE = ("[TURN] ", " [/TURN]")
OTHER_TEXT = ("[TEXT] ", " [/TEXT]")
BEGIN = "<s>"

_CONTROL = r"([<\[])(/?(?:s>|(?:SYS|INST|BOT|TURN|TEXT)\]))"
_TURN = r"(?s)\[SYS\] .*? \[/SYS\]|\[INST\] .*? \[/INST\]|\[BOT\] .*? </s>|\[TURN\] .*? \[/TEXT\]"


def escape(text: Column) -> Column:
    """A backslash after the first character breaks every control string; backslashes are doubled."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _CONTROL, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _turn(role: Column, text: Column) -> Column:
    out = F.concat(F.lit(OTHER_ROLE[0]), escape(role), F.lit(OTHER_ROLE[1] + OTHER_TEXT[0]), escape(text), F.lit(OTHER_TEXT[1]))
    for name, (a, b) in MARKS.items():
        out = F.when(role == name, F.concat(F.lit(a), escape(text), F.lit(b))).otherwise(out)
    return out


def format_chats(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, role, text) as examples (conv_id, example, target_turn, text, loss_start, loss_len).

    One example for each assistant turn, numbered from 1: the conversation up to and with it, and under the
    loss mask, ``loss_len`` code points from ``loss_start`` (from 0), that reply alone. Where a conversation doesn't end
    with an assistant turn, a last example holds all of it with an empty mask, so that no turn is lost.
    Turns are ordered by (turn, role, text); repeated rows stay repeated turns. Null turn: first. Null role: ''.
    Null text: ''. Null conv_id: one conversation. Other roles are marked with their name. Other columns go.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    made = turns.select("conv_id", F.struct("turn", role.alias("role"), _turn(role, text).alias("f")).alias("t"))
    made = made.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    made = made.select("conv_id", "ts", F.transform("ts", lambda t: t["f"]).alias("f"))
    ends = F.filter(F.sequence(F.lit(1), F.size("ts")), lambda i: (F.get("ts", i - 1)["role"] == "assistant") | (i == F.size("ts")))
    made = made.select("conv_id", "ts", "f", F.posexplode(ends).alias("example", "upto"))
    last = F.get("ts", F.col("upto") - 1)
    made = made.select(
        "conv_id",
        (F.col("example") + 1).cast("long").alias("example"),
        F.when(last["role"] == "assistant", last["turn"]).alias("target_turn"),
        F.concat(F.lit(BEGIN), F.array_join(F.slice("f", F.lit(1), F.col("upto")), "")).alias("text"),
        F.when(last["role"] == "assistant", F.length(last["f"]) - sum(map(len, MARKS["assistant"]))).otherwise(0).cast("long").alias("loss_len"),
    )
    start = F.when(F.col("loss_len") + F.col("target_turn").isNotNull().cast("int") > 0, F.length("text") - F.col("loss_len") - len(MARKS["assistant"][1]))
    return made.select("conv_id", "example", "target_turn", "text", F.coalesce(start, F.length("text")).cast("long").alias("loss_start"), "loss_len")


def read_turns(text: Column) -> Column:
    """The turns of a formatted text: array of (role, text)."""

    def turn(t: Column) -> Column:
        cut = lambda a, b: unescape(F.substring(t, F.lit(len(a) + 1), F.length(t) - len(a) - len(b)))
        between = OTHER_ROLE[1] + OTHER_TEXT[0]
        at = F.instr(t, between)
        out = F.struct(
            unescape(F.substring(t, F.lit(len(OTHER_ROLE[0]) + 1), at - len(OTHER_ROLE[0]) - 1)).alias("role"),
            unescape(F.substring(t, at + len(between), F.length(t) - at - len(between) - len(OTHER_TEXT[1]) + 1)).alias("text"),
        )
        for name, (a, b) in MARKS.items():
            out = F.when(F.startswith(t, F.lit(a)), F.struct(F.lit(name).alias("role"), cut(a, b).alias("text"))).otherwise(out)
        return out

    return F.transform(F.regexp_extract_all(text, F.lit(_TURN), 0), turn)


#: The conversation of control strings that the query adds.
PROBE = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = ", ".join(f"({conv}L, {turn}L, '{role}', '{text}')" for conv, turn, role, text in PROBE)
    turns = turns.unionByName(spark.sql(f"SELECT * FROM VALUES {probe} AS t(conv_id, turn, role, text)"))
    made = format_chats(turns)
    trained = unescape(F.substring(F.col("text"), (F.col("loss_start") + 1).cast("int"), F.col("loss_len").cast("int")))
    seen = made.groupBy("conv_id").agg(
        F.max(F.struct("example", "text"))["text"].alias("whole"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", trained.alias("x")))), lambda s: s["x"]), "").alias("loss"),
        F.sum(F.length("text")).cast("long").alias("formatted_chars"),
    )
    seen = seen.select("*", read_turns(F.col("whole")).alias("ts"))
    said = F.array_join(F.transform("ts", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return seen.select(
        "conv_id",
        F.size("ts").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


OP8_SQL = r"""
WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
f AS (SELECT *, length(regexp_replace(replace(text, '\', '\\'), '([<\[])(/?(?:s>|(?:SYS|INST|BOT|TURN|TEXT)\]))', '\1\\\2', 'g'))
    + CASE role WHEN 'system' THEN 13 WHEN 'user' THEN 15 WHEN 'assistant' THEN 11 END AS n FROM c),
g AS (SELECT *, 3 + sum(n) OVER (PARTITION BY conv_id ORDER BY turn) AS upto, turn = max(turn) OVER (PARTITION BY conv_id) AS last FROM f)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (role = 'assistant' OR last) AS BIGINT) AS formatted_chars
FROM g GROUP BY conv_id
"""
