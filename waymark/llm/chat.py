"""Chat formatting by Spark expressions alone: turns to one training text with a loss mask.

A conversation becomes blocks, one for each run of adjacent turns of one role:
`<s>`, the role, a line end, the texts separated by `<n>`, and `</s>` with a line end.
Inside texts every control string (those of this template and further ones that
tokenizers treat as special) gets a backslash after its first character, and one that
has backslashes there already gets one more, so `unescape` is the exact inverse. A role
is URL-encoded. The loss mask is a list of byte ranges of the UTF-8 text, one for each
text of a trained role, headers and separators left out.

Turns are sorted and merged by a fold over an array, in two steps. The first one takes
the turns of a range of `chunk` turn numbers, so a conversation of any length is escaped
and merged by many tasks; the second joins the few chunks of a conversation and merges
where two of them meet within a run of one role. Only the text that is returned, one row
a conversation, is as long as the conversation.

Edge cases: a null text or role is empty; null turns come first; rows that tie on the
turn are sorted by role, then text, and repeated rows are turns of their own (ties are
not split: a conversation whose rows all have one turn number is one chunk); rows of a
null id are one conversation; turns that are no numbers make one chunk; an empty table
gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from waymark.llm._common import table

OPEN, NEXT, CLOSE = "<s>", "<n>", "</s>\n"
#: Strings that mark turns here or in common templates.
CONTROLS = ("<s>", "<n>", "</s>", "[INST]", "[/INST]", "<|im_start|>", "<|im_end|>", "<|startoftext|>", "<|endoftext|>", "<pad>", "<unk>")
TRAINED = ("assistant",)
#: Turn numbers of one chunk.
CHUNK = 64


def _rests(controls: tuple[str, ...]) -> str:
    """What follows the first character of a control string, as a pattern."""
    if any(c[0] not in "<[" or re.search(r"[<\[\\]", c[1:]) for c in controls):
        raise ValueError("a control string starts with < or [ and holds no further one and no backslash")
    return "|".join(re.sub(r"([\]\[|.*+?(){}^$\\])", r"\\\1", c[1:]) for c in controls)


def escape(text: Column, controls: tuple[str, ...] = CONTROLS) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)({_rests(controls)})", r"$1\\$2$3")


def unescape(text: Column, controls: tuple[str, ...] = CONTROLS) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)({_rests(controls)})", "$1$2$3")


def _header(role: Column) -> Column:
    return F.concat(F.lit(OPEN), F.url_encode(role), F.lit("\n"))


def _lead(before: Column, role: Column) -> Column:
    """What stands before a text, after one of the role `before` (null: none in this chunk)."""
    return F.when(before.isNull(), F.lit("")).when(before == role, F.lit(NEXT)).otherwise(F.concat(F.lit(CLOSE), _header(role)))


_SPANS = "array<struct<start:bigint,end:bigint>>"


def format_chats(
    turns: DataFrame,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    trained: tuple[str, ...] = TRAINED,
    controls: tuple[str, ...] = CONTROLS,
    chunk: int = CHUNK,
) -> DataFrame:
    """A row per conversation: `conv_id`, `formatted`, `loss_spans` (byte ranges, end exclusive)."""
    numeric = isinstance(turns.schema[turn].dataType, NumericType)
    rows = turns.select(
        F.col(conv_id).alias("conv_id"),
        (F.floor(F.col(turn) / chunk) if numeric else F.lit(0)).alias("chunk"),
        F.struct(
            F.col(turn).alias("turn"),
            F.coalesce(F.col(role), F.lit("")).alias("role"),
            F.coalesce(F.col(text), F.lit("")).alias("text"),
        ).alias("t"),
    )
    chunks = rows.groupBy("conv_id", "chunk").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    plain = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), escape(t["text"], controls).alias("text")))

    def merge(acc: Column, t: Column) -> Column:
        lead = _lead(acc["role"], t["role"])
        start = acc["bytes"] + F.octet_length(lead)
        end = start + F.octet_length(t["text"])
        own = F.array(F.struct(start.cast("long").alias("start"), end.cast("long").alias("end")))
        return F.struct(
            t["role"].alias("role"),
            F.concat(acc["pieces"], F.array(F.concat(lead, t["text"]))).alias("pieces"),
            end.cast("long").alias("bytes"),
            F.when(t["role"].isin(*trained), F.concat(acc["spans"], own)).otherwise(acc["spans"]).alias("spans"),
        )

    start = F.struct(
        F.lit(None).cast("string").alias("role"),
        F.array().cast("array<string>").alias("pieces"),
        F.lit(0).cast("long").alias("bytes"),
        F.array().cast(_SPANS).alias("spans"),
    )
    merged = chunks.select("conv_id", "chunk", F.element_at("turns", 1)["role"].alias("first"), F.aggregate(plain, start, merge).alias("m"))
    parts = merged.select(
        "conv_id",
        F.struct("chunk", "first", F.col("m.role").alias("last"), F.array_join("m.pieces", "").alias("body"), "m.bytes", "m.spans").alias("part"),
    )

    def join(acc: Column, p: Column) -> Column:
        lead = F.when(acc["role"].isNull(), _header(p["first"])).otherwise(_lead(acc["role"], p["first"]))
        at = acc["bytes"] + F.octet_length(lead)
        moved = F.transform(p["spans"], lambda s: F.struct((s["start"] + at).alias("start"), (s["end"] + at).alias("end")))
        return F.struct(
            p["last"].alias("role"),
            F.concat(acc["pieces"], F.array(lead, p["body"])).alias("pieces"),
            (at + p["bytes"]).cast("long").alias("bytes"),
            F.concat(acc["spans"], F.array(moved)).alias("spans"),
        )

    empty = F.struct(
        F.lit(None).cast("string").alias("role"),
        F.array().cast("array<string>").alias("pieces"),
        F.lit(0).cast("long").alias("bytes"),
        F.array().cast(f"array<{_SPANS}>").alias("spans"),
    )
    joined = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    folded = joined.select("conv_id", F.aggregate("parts", empty, join).alias("m"))
    return folded.select(
        "conv_id",
        F.concat(F.array_join("m.pieces", ""), F.lit(CLOSE)).alias("formatted"),
        F.flatten("m.spans").alias("loss_spans"),
    )


def read_turns(formatted: Column, controls: tuple[str, ...] = CONTROLS) -> Column:
    """The turns of a formatted text: an array of (role, text), unescaped."""

    def block(b: Column) -> Column:
        end = F.locate("\n", b)
        role = F.url_decode(F.substring(b, F.lit(len(OPEN) + 1), end - len(OPEN) - 1))
        body = F.substring(b, end + 1, F.length(b))
        return F.transform(F.split(body, NEXT), lambda t: F.struct(role.alias("role"), unescape(t, controls).alias("text")))

    blocks = F.split(formatted, CLOSE)
    return F.flatten(F.transform(F.slice(blocks, 1, F.size(blocks) - 1), block))


def read_loss(formatted: Column, spans: Column, controls: tuple[str, ...] = CONTROLS) -> Column:
    """The texts under the loss mask, unescaped, in order, nothing between them."""

    def under(raw: Column) -> Column:
        cut = F.transform(spans, lambda s: F.substring(raw, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))
        return F.array_join(F.transform(cut, lambda piece: unescape(piece.cast("string"), controls)), "")

    return F.transform(F.array(formatted.cast("binary")), under)[0]


def op13_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    planted = spark.range(2).select(
        F.lit(-1).cast(turns.schema["conv_id"].dataType).alias("conv_id"),
        F.col("id").cast(turns.schema["turn"].dataType).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(probe).alias("text"),
    )
    done = format_chats(turns.unionByName(planted))
    read = done.select(
        "conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")
    )
    listed = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(listed, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) AS r(i)),
b AS (
  SELECT *, role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS opens,
    regexp_replace(text, '([<\[])(\\*)({_rests(CONTROLS)})', '\1\\\2\3', 'g') AS escaped
  FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(escaped) + CASE WHEN opens THEN length(role) + 9 ELSE 3 END) AS BIGINT) AS formatted_chars
FROM b GROUP BY conv_id
"""
