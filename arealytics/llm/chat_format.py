"""Chat formatting by prefix-target expansion, in DataFrame functions only.

A turn is written `<|im_start|>role`, a line break, its text, `<|im_end|>` and a line break. Every assistant turn becomes an example of its
own: all turns up to it as text, and a loss span (code points) over this reply's text only. A conversation that does not end with an
assistant gets one more example over all its turns without a loss span, so no turn is lost.

Control strings inside texts are escaped by one backslash after their `<`; those already escaped get one more, so reading back removes
exactly one. Roles are escaped likewise, and their line breaks and backslashes become \\n and \\s.

Defined results: NULL texts and roles count as empty; turns are ordered by turn (NULL first), then role, then text, repeated rows stay;
rows without a conversation id form one conversation; an empty table gives no examples; extra columns are ignored. A conversation is held
as one array, for its last example is that text anyway; the examples together are quadratic in its turns, by the method.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|im_(start|end)\|>", r"<$1\\|im_$2|>")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|im_(start|end)\|>", r"<$1|im_$2|>")


def _role(role: Column) -> Column:
    return F.replace(F.replace(escaped(role), F.lit("\\"), F.lit("\\s")), F.lit("\n"), F.lit("\\n"))


def _role_back(role: Column) -> Column:
    return unescaped(F.replace(F.replace(role, F.lit("\\n"), F.lit("\n")), F.lit("\\s"), F.lit("\\")))


def examples(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", target: str = "assistant") -> DataFrame:
    """(conv_id, example, text, loss_start, loss_end, last): loss_end is exclusive; both are NULL where nothing is trained."""
    turns = conversations.select(F.col(conv_id).alias("conv_id"), F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"))
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    shown = F.transform("t", lambda x: F.struct(x["role"].alias("role"), F.concat(F.lit(OPEN), _role(x["role"]), F.lit("\n")).alias("head"), escaped(x["text"]).alias("body")))
    whole = whole.select("conv_id", shown.alias("t"))
    replies = F.filter(F.sequence(F.lit(1), F.size("t")), lambda i: F.element_at("t", i)["role"] == target)
    ends = F.when(F.element_at("t", -1)["role"] == target, replies).otherwise(F.concat(replies, F.array(F.size("t"))))
    each = whole.select("conv_id", "t", F.posexplode(ends).alias("example", "end"))
    final = F.element_at("t", F.col("end"))
    joined = F.array_join(F.transform(F.slice("t", F.lit(1), F.col("end")), lambda x: F.concat(x["head"], x["body"], F.lit(CLOSE))), "")
    made = each.select("conv_id", "example", joined.alias("text"), (final["role"] == target).alias("trained"), F.length(final["body"]).alias("n"), (F.col("end") == F.size("t")).alias("last"))
    stop = F.length("text") - len(CLOSE)
    return made.select("conv_id", "example", "text", F.when(F.col("trained"), stop - F.col("n")).alias("loss_start"), F.when(F.col("trained"), stop).alias("loss_end"), "last")


def read_back(text: Column) -> Column:
    """The turns of an example's text: array of (role, text)."""
    pieces = F.split(text, r"<\|im_start\|>", -1)
    pieces = F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0)))
    parted = F.transform(pieces, lambda p: F.struct(p.alias("p"), F.substring_index(p, "\n", 1).alias("head")))
    return F.transform(parted, lambda x: F.struct(_role_back(x["head"]).alias("role"), unescaped(F.substr(x["p"], F.length(x["head"]) + 2, F.length(x["p"]) - F.length(x["head"]) - 1 - len(CLOSE))).alias("text")))


def digests(made: DataFrame) -> DataFrame:
    """One row per conversation, read back from the examples' texts and loss spans."""
    turns = F.when(F.col("last"), read_back(F.col("text")))
    one = made.select("conv_id", "example", F.length("text").alias("chars"), turns.alias("turns"), unescaped(F.substr("text", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start"))).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    one = one.select("conv_id", "example", "chars", F.size("turns").cast("long").alias("n"), F.when(F.col("turns").isNotNull(), F.sha2(said, 256)).alias("sha"), F.coalesce("loss", F.lit("")).alias("loss"))
    grouped = one.groupBy("conv_id").agg(F.max("n").alias("n_turns"), F.max("sha").alias("turns_sha256"), F.sum(F.length("loss")).alias("loss_chars"),
                                         F.sort_array(F.collect_list(F.struct("example", "loss"))).alias("replies"), F.sum(F.col("chars").cast("long")).alias("formatted_chars"))
    loss = F.sha2(F.array_join(F.transform("replies", lambda r: r["loss"]), ""), 256)
    return grouped.select("conv_id", "n_turns", "turns_sha256", "loss_chars", loss.alias("loss_sha256"), "formatted_chars")
