"""Quotation linking: nested quote levels, hashed passages, reply-ordered conversations without quotes.

DataFrame functions only.  Lines that begin with ``>`` marks are quotes, as many levels deep
as they have marks; a run of lines of one level is a quoted passage.  Passages and their
lines, normalised to lower-case letters and digits, are joined by hash (and text) to the
whole texts, paragraphs and lines of earlier messages of the conversation.  The best match
at the outermost level is the message replied to; a message without one replies to the turn
before it.

"Latest turn before" look-ups never put a whole conversation into one task: turns are cut
into blocks, a window runs inside a block, and one row per block carries over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probity.llm.common import fresh_name, materialise

TURN_BLOCK = 1_024
_MARK = r"^(?:[ \t]{0,3}>)+ ?"
_HAS_QUOTE = r"(?m)^[ \t]{0,3}>"
_ROOT = -(1 << 63)


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def own_text(text: Column) -> Column:
    """The text without quoted lines and without the white space they leave at its ends; a text without quotes stays as it is."""
    left = F.array_join(F.filter(F.split(text, "\n"), lambda x: ~x.rlike(r"^[ \t]{0,3}>")), "\n")
    return F.when(text.rlike(_HAS_QUOTE), F.regexp_replace(F.regexp_replace(left, r"^\s+", ""), r"\s+$", "")).otherwise(text)


def _latest_before(events: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``events`` with ``before``: the largest ``value`` (a turn, or null) on rows of the same keys with a smaller turn.

    Two levels: inside blocks of turns, and over one row per block.
    """
    events = events.withColumn("_block", F.floor(F.col("turn") / TURN_BLOCK))
    inside = Window.partitionBy(*keys, "_block").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    blocks = events.where(F.col(value).isNotNull()).groupBy(*keys, "_block").agg(F.max(value).alias("_last"))
    # every block that has rows, with the largest value of the blocks before it
    whole = events.select(*keys, "_block").distinct().join(blocks, [*keys, "_block"], "left")
    over = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = whole.select(*keys, "_block", F.max("_last").over(over).alias("_carried"))
    return (events.withColumn("_in", F.max(value).over(inside)).join(carried, [*keys, "_block"])
            .withColumn("before", F.coalesce("_in", "_carried")).drop("_block", "_in", "_carried"))


def quoted_passages(messages: DataFrame) -> DataFrame:
    """(conv, turn, level, run, passage): quoted passages of messages (conv, turn, text), nested marks removed."""
    quoting = messages.where(F.col("text").rlike(_HAS_QUOTE)).distinct().withColumn("row", F.xxhash64("text"))
    lines = quoting.select("conv", "turn", "row", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    mark = F.regexp_extract("line", _MARK, 0)
    lines = lines.select("conv", "turn", "row", "i", F.length(F.regexp_replace(mark, "[^>]", "")).alias("level"),
                         F.regexp_replace("line", _MARK, "").alias("body"))
    order = Window.partitionBy("conv", "turn", "row").orderBy("i")  # one message
    lines = lines.withColumn("run", F.sum((F.col("level") != F.lag("level", 1, -1).over(order)).cast("int")).over(order))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "body"))), lambda x: x["body"]), "\n")
    return lines.where("level > 0").groupBy("conv", "turn", "row", "level", "run").agg(body.alias("passage")).drop("row")


def _units(text: Column, paragraphs: bool) -> Column:
    """Normalised whole text, paragraphs and lines, each once."""
    parts = [F.array(text), F.split(text, "\n")] + ([F.split(text, r"\n\s*\n")] if paragraphs else [])
    return F.filter(F.array_distinct(F.transform(F.concat(*parts), normalised)), lambda x: x != "")


def quote_links(messages: DataFrame) -> DataFrame:
    """(conv, turn, level, target, weight): for each message and level, earlier turns that its quotes are from."""
    quoted = (quoted_passages(messages).select("conv", "turn", "level", F.explode(_units(F.col("passage"), True)).alias("unit"))
              .groupBy("conv", "unit", "turn").agg(F.min("level").alias("level")))
    origin = (messages.join(quoted.select("conv").distinct(), "conv", "left_semi")
              .select("conv", "turn", F.explode(_units(own_text(F.col("text")), True)).alias("unit")).distinct()
              .join(quoted.select("conv", "unit").distinct(), ["conv", "unit"], "left_semi"))
    events = (quoted.select("conv", "unit", "turn", "level", F.lit(None).cast("long").alias("origin"))
              .unionByName(origin.select("conv", "unit", "turn", F.lit(None).cast("int").alias("level"), F.col("turn").alias("origin")))
              .withColumn("hash", F.xxhash64("unit")))
    found = _latest_before(events, ["conv", "hash", "unit"], "origin").where("level is not null and before is not null")
    return found.groupBy("conv", "turn", "level", F.col("before").alias("target")).agg(F.sum(F.length("unit")).alias("weight"))


def link_quotations(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text") -> DataFrame:
    """``messages`` without quotes in their text, with the reply structure of their conversation.

    New columns: parent_turn (the message replied to: the best quoted one, else the turn
    before; null for the first), quoted_turns (turns that its quotes are from, ascending),
    n_quotes and max_level of its quoted passages, depth (quote branches above it) and
    reply_path.  Ordering a conversation by reply_path puts every reply after its parent and
    before the parent's next turns.

    Null texts stay null and quote nothing, empty ones are their own text.  Rows whose
    conversation or turn is null have no parent and no path.  Rows that repeat a (conversation,
    turn) are one message: they share quotes, parent and path, each with its own text.
    Existing columns with the new names are replaced, all others pass through.  Quotes that
    match no earlier message are cut from the text and counted, but link nothing.
    """
    new = ["parent_turn", "quoted_turns", "n_quotes", "max_level", "depth", "reply_path"]
    keyed = messages.select(F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").cast("long").alias("turn"),
                            F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).where("conv is not null and turn is not null")
    links = materialise(quote_links(keyed))
    counts = materialise(quoted_passages(keyed).groupBy("conv", "turn").agg(F.count("*").alias("n_quotes"), F.max("level").cast("long").alias("max_level")))
    best = links.groupBy("conv", "turn").agg(F.max(F.struct(-F.col("level"), "weight", "target")).alias("b"),
                                             F.array_sort(F.collect_set("target")).alias("quoted_turns"))
    turns = keyed.select("conv", "turn").distinct().withColumn("own", F.col("turn"))
    turns = (_latest_before(turns, ["conv"], "own").withColumnRenamed("before", "previous").drop("own")
             .join(best, ["conv", "turn"], "left")
             .select("conv", "turn", "previous", F.col("b.target").alias("target"), "quoted_turns"))
    starts = F.when(F.col("target").isNotNull() & ~F.col("target").eqNullSafe(F.col("previous")), F.col("turn"))
    turns = materialise(_latest_before(turns.withColumn("start", starts), ["conv"], "start")
                        .select("conv", "turn", "previous", "target", "quoted_turns", F.coalesce("start", "before", F.lit(_ROOT)).alias("branch")))

    # a branch begins where a message answers another than the turn before; its path is that of
    # the branch it answers and then (answered turn, own first turn), found by doubling
    begun = turns.where("branch = turn").select("conv", F.col("turn").alias("branch"), "target")
    above = turns.select("conv", F.col("turn").alias("target"), F.col("branch").alias("up"))
    paths = materialise(begun.join(above, ["conv", "target"]).select("conv", "branch", "up", F.array("target", "branch").alias("path")))
    while not paths.where(F.col("up") != _ROOT).isEmpty():
        upper = paths.select("conv", F.col("branch").alias("up"), F.col("up").alias("_up"), F.col("path").alias("_path"))
        paths = materialise(paths.join(upper, ["conv", "up"], "left").select(
            "conv", "branch", F.coalesce("_up", F.lit(_ROOT)).alias("up"), F.concat(F.coalesce("_path", F.array().cast("array<bigint>")), "path").alias("path")))
    path = F.coalesce("path", F.array().cast("array<bigint>"))
    placed = (turns.join(paths.select("conv", "branch", "path"), ["conv", "branch"], "left").join(counts, ["conv", "turn"], "left")
              .select(F.col("conv").alias("_conv"), F.col("turn").alias("_turn"), F.coalesce("target", "previous").alias("parent_turn"),
                      F.coalesce("quoted_turns", F.array().cast("array<bigint>")).alias("quoted_turns"), F.coalesce("n_quotes", F.lit(0)).alias("n_quotes"),
                      F.coalesce("max_level", F.lit(0)).alias("max_level"), (F.size(path) / 2).cast("long").alias("depth"),
                      F.concat(path, F.array("turn")).alias("reply_path")))
    base = messages.drop(*new)
    conv, turn = fresh_name(base, "_conv"), fresh_name(base, "_turn")
    placed = placed.withColumnsRenamed({"_conv": conv, "_turn": turn})
    cols = [own_text(F.col(f"`{c}`")).alias(c) if c == text_col else F.col(f"`{c}`") for c in base.columns]
    return (base.join(placed, (F.col(f"`{conv_col}`") == F.col(conv)) & (F.col(f"`{turn_col}`").cast("long") == F.col(turn)), "left")
            .select(*cols, *new))
