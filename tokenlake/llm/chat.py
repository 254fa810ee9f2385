r"""Chat formatting as Spark expressions: sorted turn structs, merged same-role blocks, loss mask, read-back.

Template, one block per run of turns with the same role:

    <|turn|>ROLE<|says|>TEXT[<|next|>TEXT ...]<|end|>\n

Control strings inside roles and texts are escaped reversibly: in ``<|``, ``<s>``, ``</s>``, ``[INST]`` and
``[/INST]``, with any number of backslashes after the first character, one more backslash goes there. Reading
back takes one away. So no control string survives in a text, and every text comes back as it was.

Turns are ordered by (turn, role, text). Defined cases: null role or text counts as empty; a null turn sorts
first; repeated rows are turns of their own; a null conv_id is a conversation like any other; empty table, empty
result; extra columns are ignored. A conversation is one output row, so its size is bounded by what a row can hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, SAYS, NEXT, END = "<|turn|>", "<|says|>", "<|next|>", "<|end|>\n"
CONTROL = r"(\||/?s>|/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + CONTROL, "$1$2$3")


def collect_turns(rows: DataFrame) -> DataFrame:
    """conv_id, turns: array of (turn, role, text), sorted."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    turn = F.struct(F.col("turn"), text("role").alias("role"), text("text").alias("text"))
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))


def merge_turns(df: DataFrame) -> DataFrame:
    """Add ``blocks``: adjacent turns of one role as (role, texts), roles and texts escaped."""
    turns, starts = F.col("turns"), F.col("_starts")
    df = df.withColumn("_starts", F.filter(F.sequence(F.lit(0), F.size(turns) - 1), lambda i: (i == 0) | (F.get(turns, i)["role"] != F.get(turns, i - 1)["role"])))
    block = lambda at, k: F.struct(
        escape(F.get(turns, at)["role"]).alias("role"),
        F.transform(F.slice(turns, at + 1, F.coalesce(F.get(starts, k + 1), F.size(turns)) - at), lambda t: escape(t["text"])).alias("texts"),
    )
    return df.withColumn("blocks", F.transform(starts, block)).drop("_starts")


def _starts(pieces: str, block: int = 256) -> Column:
    """Where each piece's text starts once all are joined. Starts gather in blocks, so that a step copies one block at most."""
    ints = "array<int>"
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(ints).alias("part"), F.array().cast(f"array<{ints}>").alias("whole"))

    def step(acc: Column, p: Column) -> Column:
        full = F.size(acc["part"]) == block
        here = F.array(acc["at"])
        part = F.when(full, here).otherwise(F.concat(acc["part"], here))
        whole = F.when(full, F.concat(acc["whole"], F.array(acc["part"]))).otherwise(acc["whole"])
        return F.struct((acc["at"] + F.length(p["text"])).alias("at"), part.alias("part"), whole.alias("whole"))

    return F.aggregate(pieces, zero, step, lambda acc: F.concat(F.flatten(acc["whole"]), acc["part"]))


def render(df: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Add ``formatted`` and ``loss_spans``: (start from 0, length) in code points, one span for each text of ``loss_role``."""
    piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    no = F.lit(False)

    def of_block(b: Column) -> Column:
        says = F.transform(b["texts"], lambda t, j: F.array(piece(F.when(j > 0, NEXT).otherwise(""), no), piece(t, b["role"] == loss_role)))
        return F.concat(F.array(piece(F.concat(F.lit(TURN), b["role"], F.lit(SAYS)), no)), F.flatten(says), F.array(piece(F.lit(END), no)))

    df = df.withColumn("_pieces", F.flatten(F.transform("blocks", of_block)))
    spans = F.zip_with("_pieces", _starts("_pieces"), lambda p, at: F.struct(at.alias("start"), F.length(p["text"]).alias("length"), p["loss"].alias("loss")))
    spans = F.transform(F.filter(spans, lambda s: s["loss"]), lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length")))
    return df.withColumn("formatted", F.array_join(F.transform("_pieces", lambda p: p["text"]), "")).withColumn("loss_spans", spans).drop("_pieces")


def format_conversations(rows: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_spans."""
    return render(merge_turns(collect_turns(rows)), loss_role).select("conv_id", "formatted", "loss_spans")


def parse(df: DataFrame) -> DataFrame:
    """Add ``parsed`` (array of (role, text), a turn each) and ``loss_text``, both from ``formatted`` alone."""
    blocks = F.filter(F.split("formatted", r"<\|end\|>\n"), lambda b: b != "")

    def turns(b: Column) -> Column:
        role = F.substring_index(F.substr(b, F.lit(len(TURN) + 1)), SAYS, 1)
        texts = F.split(F.substr(b, F.length(role) + len(TURN) + len(SAYS) + 1), r"<\|next\|>")
        return F.transform(texts, lambda t: F.struct(unescape(role).alias("role"), unescape(t).alias("text")))

    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["length"]))), "")
    return df.withColumn("parsed", F.flatten(F.transform(blocks, turns))).withColumn("loss_text", loss)


def digest(df: DataFrame) -> DataFrame:
    turns = F.array_join(F.transform("parsed", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return df.select(
        "conv_id",
        F.size("parsed").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def with_probe(rows: DataFrame) -> DataFrame:
    """The rows, and conversation -1, whose two texts are full of control strings."""
    probe = rows.sparkSession.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text")
    )
    return rows.select("conv_id", "turn", "role", "text").unionByName(probe)
