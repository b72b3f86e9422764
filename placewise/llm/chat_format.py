"""Chat formatting: turns checked by a finite-state machine over roles, written as segments with loss flags.

A template is plain data: marks around a turn, an escape character, control strings, the roles whose text is learned, and
the machine's transitions. Inside roles and texts the escape character is doubled and put behind the first character of
every control string, so no mark can occur there and `unescaped` gives the text back. Everything is DataFrame code.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


@dataclass(frozen=True)
class Template:
    """`before` + role + `between` + text + `after` is a turn. Every mark must hold a control string; control strings
    have two characters or more and no escape character."""

    before: str = "<|turn:"
    between: str = "|>\n"
    after: str = "<|close|>\n"
    controls: tuple[str, ...] = ("<|", "|>")
    escape: str = "\\"
    learned: tuple[str, ...] = ("assistant",)
    start: str = "start"
    accepting: tuple[str, ...] = ("user", "assistant")
    moves: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "system", "user": "user"},
            "system": {"user": "user"},
            "user": {"assistant": "assistant"},
            "assistant": {"user": "user"},
        }
    )


def escaped(text: Column, template: Template) -> Column:
    e = template.escape
    text = F.replace(text, F.lit(e), F.lit(e + e))
    for c in template.controls:
        text = F.replace(text, F.lit(c), F.lit(c[0] + e + c[1:]))
    return text


def unescaped(text: Column, template: Template) -> Column:
    return F.regexp_replace(text, "(?s)" + re.escape(template.escape) + "(.)", "$1")


def final_state(turns: Column, template: Template) -> Column:
    """State after all roles in order; null once a role has no move."""

    def move(state: Column, turn: Column) -> Column:
        out = F.lit(None).cast("string")
        for origin, moves in template.moves.items():
            for role, target in moves.items():
                out = F.when((state == origin) & (turn["role"] == role), F.lit(target)).otherwise(out)
        return out

    return F.aggregate(turns, F.lit(template.start), move)


def formatted(rows: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, valid, segments and formatted of every conversation of (conv_id, turn, role, text).

    Turns stand in the order of `turn`, then role, then text (nulls first), so ties and repeated rows have one order and
    all stay. A null role or text is empty; rows with a null conv_id are one conversation. Invalid conversations are
    formatted too, with valid = false. A conversation is one row of the result, so its turns are gathered in one task.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = rows.select("conv_id", F.struct("turn", text("role").alias("role"), text("text").alias("text")).alias("t"))
    held = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))

    def segment(value: Column, loss: Column) -> Column:
        return F.struct(value.alias("text"), loss.alias("loss"))

    def of_turn(t: Column) -> Column:
        mark = F.concat(F.lit(template.before), escaped(t["role"], template), F.lit(template.between))
        return F.array(segment(mark, F.lit(False)), segment(escaped(t["text"], template), t["role"].isin(*template.learned)), segment(F.lit(template.after), F.lit(False)))

    made = held.select(
        "conv_id",
        F.coalesce(final_state(F.col("turns"), template).isin(*template.accepting), F.lit(False)).alias("valid"),
        F.flatten(F.transform("turns", of_turn)).alias("segments"),
    )
    return made.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_turns(text: Column, template: Template = Template()) -> Column:
    """The turns (role, text) of a formatted conversation."""

    def turn(piece: Column) -> Column:
        at = F.instr(piece, F.lit(template.between))
        opened = len(template.before)
        role = F.substring(piece, F.lit(opened + 1), at - 1 - opened)
        rest = F.substring(piece, at + len(template.between), F.length(piece))
        return F.struct(unescaped(role, template).alias("role"), unescaped(rest, template).alias("text"))

    pieces = F.split(text, re.escape(template.after))
    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), turn)  # nothing follows the last mark


def digests(made: DataFrame, template: Template = Template()) -> DataFrame:
    """What a reader gets back from the formatted text and the segments, as counts and hashes."""
    turns = read_turns(F.col("formatted"), template)
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"], template)), "")
    read = made.select("conv_id", "valid", "formatted", turns.alias("turns"), loss.alias("loss"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
        "valid",
    )


PROBE = "\\### Assistant: </turn> ok"


def op6_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations and one whose texts hold signs that other templates use as marks."""
    rows = spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text")
    )
    return digests(formatted(rows.unionByName(probe)))


_ESCAPED = r"replace(replace(replace({0}, '\', '\\'), '<|', '<\|'), '|>', '|\>')"
OP6_SQL = rf"""
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '{PROBE}' UNION ALL SELECT -7, 1, 'assistant', '{PROBE}'
), steps AS (
    SELECT *, lag(role) OVER w AS earlier, row_number() OVER w AS k FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), told AS (
    SELECT *, CASE WHEN k = 1 THEN role IN ('system', 'user') WHEN role = 'user' THEN earlier IN ('system', 'assistant')
                   WHEN role = 'assistant' THEN earlier = 'user' ELSE false END AS fits FROM steps
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length({_ESCAPED.format('role')}) + length({_ESCAPED.format('text')}) + 20) AS BIGINT) AS formatted_chars,
       bool_and(fits) AND arg_max(role, k) IN ('user', 'assistant') AS valid
FROM told GROUP BY conv_id
"""
