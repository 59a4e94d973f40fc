"""Chat formatting with Spark expressions only.

A conversation becomes ``<|im_start|>role\\ntext<|im_end|>\\n`` per turn. Adjacent rows of one role share a turn block,
their texts parted by ``<|im_part|>``, so that the rows can be read back. Control strings inside texts gain a backslash
(``<|`` becomes ``<\\|``, ``<\\|`` becomes ``<\\\\|`` ...), and roles have backslash, line feed and ``<`` escaped.

Defined results: null text or role counts as empty; a null turn sorts first; rows with equal turns are ordered by role,
then text, and repeated rows are all kept; a null conv_id is one conversation; an empty table gives an empty result;
other columns are ignored. A conversation's output is one string, so its rows meet in one task by nature of the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, PART, END = "<|im_start|>", "<|im_part|>", "<|im_end|>"
_END_RE, _PART_RE = r"<\|im_end\|>\n", r"<\|im_part\|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n")), F.lit("<"), F.lit("\\l"))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("\\l"), F.lit("<")), F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def format_conversations(conversations: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted (the whole text), segments (text, loss): their texts joined are ``formatted``; loss marks the training targets."""
    rows = conversations.select(
        "conv_id", F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("row")
    )
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    starts = turns.withColumn(
        "starts",
        F.filter(
            F.sequence(F.lit(0), F.size("rows") - 1),
            lambda i: (i == 0) | (F.get(F.col("rows"), i)["role"] != F.get(F.col("rows"), i - 1)["role"]),
        ),
    )
    blocks = starts.select(
        "conv_id",
        F.transform(
            "starts", lambda s, k: F.slice(F.col("rows"), s + 1, F.coalesce(F.get(F.col("starts"), k + 1), F.size("rows")) - s)
        ).alias("blocks"),
    )

    def segment(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    def block(rows: Column) -> Column:
        opening = F.concat(F.lit(START), escape_role(rows[0]["role"]), F.lit("\n"))
        body = F.transform(
            rows,
            lambda r, i: F.array(
                segment(F.when(i == 0, opening).otherwise(F.lit(PART)), F.lit(False)),
                segment(escape(r["text"]), r["role"] == loss_role),
            ),
        )
        return F.concat(F.flatten(body), F.array(segment(F.lit(END + "\n"), F.lit(False))))

    out = blocks.select("conv_id", F.flatten(F.transform("blocks", block)).alias("segments"))
    return out.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def parse_formatted(formatted: Column) -> Column:
    """Reads array<struct<role, text>> back from a formatted text, one entry for each original row."""
    blocks = F.filter(F.split(formatted, _END_RE), lambda b: F.startswith(b, F.lit(START)))

    def parts(block: Column) -> Column:
        head = F.substring_index(block, "\n", 1)
        role = unescape_role(F.substr(head, F.lit(len(START) + 1)))
        return F.transform(
            F.split(F.substr(block, F.length(head) + 2), _PART_RE), lambda t: F.struct(role.alias("role"), unescape(t).alias("text"))
        )

    return F.flatten(F.transform(blocks, parts))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def digest(conversations: DataFrame) -> DataFrame:
    """The contract's columns, read back from what format_conversations wrote."""
    out = format_conversations(conversations)
    back = out.select("conv_id", "formatted", parse_formatted(F.col("formatted")).alias("turns"), loss_text(F.col("segments")).alias("loss"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
