"""Chat formatting in budgeted windows, in DataFrame functions only.

Prefix sums of turn tokens cut a conversation at turns into spans; a window is the system turn, as much of the turns
before the span as ``history`` tokens hold, and the span. Only assistant turns of the span itself are targets: what
is repeated is masked, so each target is in the loss once.

A turn is written as ``### role:`` (``### (context) role:`` if repeated), a newline, its text, a newline, ``</turn>``
and a newline. Backslashes, ``###`` and ``</turn>`` in texts, and colons, newlines and more besides in roles, get a
backslash before them, so reading back is exact.

Tokens of a turn are its words and signs, about ``(letters + digits) / 4`` and one per other character, plus
``OVERHEAD``. A span holds at most ``budget`` minus ``history`` tokens besides the system turn's; a longer turn is a
window of its own and is written whole. Prefix sums are made of sums per block of turns, so no task orders a whole
conversation; a window is bounded by the budget.

Defined results: a null text is empty, a null role is an empty role; turns without a number come first, equal
numbers are ordered by role and text and repeated rows all count; only the first system turn, if the conversation
begins with it, is retained; a null ``conv_id`` is a conversation; other columns are not kept; an empty table has
no windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OVERHEAD = 4
BLOCK = 512
END = "\n</turn>\n"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, "(\\\\|###|</turn>)", "\\\\$1")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, "\\\\(\\\\|###|</turn>)", "$1")


def escaped_role(role: Column) -> Column:
    return F.regexp_replace(role, "([\\\\:#<\n(])", "\\\\$1")


def unescaped_role(role: Column) -> Column:
    return F.regexp_replace(role, "(?s)\\\\(.)", "$1")


def tokens(text: Column) -> Column:
    plain = F.length(F.regexp_replace(text, "[^\\p{L}\\p{N}]", ""))
    signs = F.length(F.regexp_replace(text, "[\\p{L}\\p{N}\\s]", ""))
    return (F.ceil(plain / 4) + signs + OVERHEAD).cast("bigint")


def windows(conversations: DataFrame, budget: int = 2048, history: int = 256) -> DataFrame:
    """``conv_id, window, formatted, loss`` (ranges of code points under the loss mask) and ``n_tokens``."""
    step = (budget - history) // 2
    rows = conversations.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("t", tokens(F.col("text"))).withColumn("block", F.floor(F.col("turn") / BLOCK))
    # A null-safe key: a null conversation or block is one like others.
    key = [F.struct(F.col("conv_id").isNull().alias("none"), F.col("conv_id").alias("id")).alias("conv"), F.struct(F.col("block").isNotNull().alias("has"), F.col("block").alias("no")).alias("blk")]
    rows = rows.select(*key, "turn", "role", "text", "t")
    per_block = rows.groupBy("conv", "blk").agg(F.sum("t").alias("sum"))
    first = Window.partitionBy("conv").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_block.select("conv", "blk", F.coalesce(F.sum("sum").over(first), F.lit(0)).alias("before"))
    in_block = Window.partitionBy("conv", "blk").orderBy(F.col("turn").asc_nulls_first(), "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inner", F.coalesce(F.sum("t").over(in_block), F.lit(0))).join(starts, ["conv", "blk"])
    placed = placed.select("conv", "role", "text", "t", (F.col("before") + F.col("inner")).alias("at"))
    # The span is where the turn begins on the scale of half the budget, so a span never holds more than the budget;
    # a turn of more than half begins its own.
    big = F.col("t") > step
    span = F.floor(F.col("at") / step) * 2 + F.when(big, 1).otherwise(0)
    placed = placed.withColumn("window", span)
    system = (F.col("at") == 0) & (F.col("role") == "system")
    heads = placed.where(system).select("conv", F.col("text").alias("system"), F.col("t").alias("system_t"))
    ends = placed.groupBy("conv", "window").agg(F.max(F.col("at") + F.col("t")).alias("end"))
    spans = placed.join(ends, ["conv", "window"])
    # What ends a span is history of the span that begins there.
    tail = (F.col("end") - F.col("at") <= history) & ~system
    begun = placed.groupBy("conv", F.col("at").alias("end")).agg(F.min("window").alias("next"))
    later = spans.where(tail).join(begun, ["conv", "end"]).select("conv", F.col("next").alias("window"), "at", "role", "text", "t", F.lit(True).alias("context"))
    own = placed.select("conv", "window", "at", "role", "text", "t", F.lit(False).alias("context"))
    opened = ends.join(heads, "conv").join(placed.where(system).select("conv", F.col("window").alias("first")), "conv").where(F.col("window") != F.col("first"))
    again = opened.select("conv", "window", F.lit(-1).cast("bigint").alias("at"), F.lit("system").alias("role"), F.col("system").alias("text"), F.col("system_t").alias("t"), F.lit(True).alias("context"))
    return formatted(own.unionByName(later).unionByName(again))


def formatted(turns: DataFrame) -> DataFrame:
    """Windows from their turns: the text of each, and where its targets are."""
    head = F.concat(F.lit("### "), F.when(F.col("context"), "(context) ").otherwise(""), escaped_role(F.col("role")), F.lit(":\n"))
    parts = turns.withColumn("head", head).withColumn("body", escaped(F.col("text")))
    parts = parts.withColumn("piece", F.concat("head", "body", F.lit(END)))
    order = Window.partitionBy("conv", "window").orderBy("at", "context")
    before = F.coalesce(F.sum(F.length("piece")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begin = F.col("before") + F.length("head")
    target = F.when((F.col("role") == "assistant") & ~F.col("context"), F.struct(begin.alias("begin"), (begin + F.length("body")).alias("end")))
    parts = parts.withColumn("before", before).withColumn("target", target)
    group = parts.groupBy("conv", "window").agg(F.sort_array(F.collect_list(F.struct("before", "piece", "target"))).alias("all"), F.sum("t").alias("n_tokens"))
    return group.select(
        F.col("conv.id").alias("conv_id"),
        "window",
        F.array_join(F.transform("all", lambda x: x["piece"]), "").alias("formatted"),
        F.filter(F.transform("all", lambda x: x["target"]), lambda x: x.isNotNull()).alias("loss"),
        "n_tokens",
    )


def read_back(found: DataFrame) -> DataFrame:
    """Turns of the windows in order, without what is repeated: per window ``turns`` (role, text) and ``targets``."""
    blocks = F.filter(F.split("formatted", END), lambda x: x != "")
    heading = "(?s)^### (\\(context\\) )?((?:[^\\\\:]++|\\\\.)*+):\n"

    def turn(x: Column) -> Column:
        text = F.substr(x, F.length(F.regexp_extract(x, heading, 0)) + 1)
        return F.struct(unescaped_role(F.regexp_extract(x, heading, 2)).alias("role"), (F.regexp_extract(x, heading, 1) != "").alias("context"), unescaped(text).alias("text"))

    own = F.filter(F.transform(blocks, turn), lambda x: ~x["context"])
    targets = F.transform("loss", lambda s: unescaped(F.substr(F.col("formatted"), s["begin"].cast("int") + 1, (s["end"] - s["begin"]).cast("int"))))
    return found.select("conv_id", "window", "formatted", own.alias("turns"), targets.alias("targets"))
