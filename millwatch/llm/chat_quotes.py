"""Conversations without their quotations, in order of reply.

A line's quote level is the number of `>` before it.  Quoted lines, and all lines of one level together, are
normalised (lower case, single spaces) and hashed; joined by conversation and hash to the message that first
wrote such a line or such a text, they tell which message is answered.  The lowest level found decides, since deeper
ones are what the answered message quoted itself; within it a passage that is a message's whole own text, of any
length, speaks before single lines, then the number of matched characters, of matches, and the later message.  Replies
get the place of their message, their depth and the first message of their thread, and keep only what they say
themselves; all messages get their position in their conversation in order of reply, counted over a range-sorted table, so that a conversation of any size spreads over
many tasks.  Everything is DataFrame work; what a
conversation wrote is reduced to the first writer of each hash before the join, so that no line, however common,
meets all its repeats, and no conversation is ever gathered in one task.

Defined results: a null text is an empty message; a message without quotes, or whose quotes are found nowhere
earlier, begins a thread; an attribution line before a quotation goes with it; messages of any length are read
whole; repeated rows give repeated rows, which share a position; a message without conv_id or turn has no position;
extra columns are kept, those named like an output column replaced; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import saved

KEY = ["conv_id", "turn"]
_MARK = r"^[ \t]*((?:>[ \t]?)+)"
_ATTRIBUTION = r"(?i)^(?:on|am|le|el)\b.*\b(?:wrote|schrieb|a écrit|escribió)\s?:\s*$"


def level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, _MARK, 1), "[^>]", ""))


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def _with_lines(messages: DataFrame) -> DataFrame:
    lines = F.split(F.coalesce(F.col("text"), F.lit("")), "\r?\n")
    marked = F.transform(lines, lambda x: F.struct(level(x).alias("level"), F.regexp_replace(x, _MARK, "").alias("words")))
    return messages.withColumn("__lines", marked)


def own_text(lines: Column) -> Column:
    """The lines of level 0, without an attribution right before a quotation, joined and trimmed."""
    kept = F.filter(lines, lambda x, i: (x["level"] == 0) & ~(x["words"].rlike(_ATTRIBUTION) & (F.coalesce(F.get(lines, i + 1)["level"], F.lit(0)) > 0)))
    return F.regexp_replace(F.array_join(F.transform(kept, lambda x: x["words"]), "\n"), r"^\s+|\s+$", "")


def _hashes(lines: Column) -> Column:
    """hash and chars of each different line, normalised, and of all of them together (``whole``); none of empty ones."""
    there = F.filter(F.transform(lines, normalised), lambda x: x != "")
    every = F.array_join(there, " ")
    told = lambda x: F.struct(F.xxhash64(x, F.length(x)).alias("hash"), F.length(x).cast("long").alias("chars"), (x == every).alias("whole"))
    return F.array_distinct(F.transform(F.filter(F.concat(there, F.array(every)), lambda x: x != ""), told))


def links(messages: DataFrame) -> DataFrame:
    """conv_id, turn, reply_to, matches: the earlier message that each message's quotations come from."""
    rows = _with_lines(messages.select(*KEY, "text"))
    own = F.transform(F.filter("__lines", lambda x: x["level"] == 0), lambda x: x["words"])
    wrote = rows.select(*KEY, F.explode(_hashes(own)).alias("x")).select(*KEY, "x.hash", "x.whole")
    quoted_at = lambda k: F.transform(F.filter("__lines", lambda x: x["level"] == k), lambda x: x["words"])
    levels = F.array_distinct(F.filter(F.transform("__lines", lambda x: x["level"]), lambda x: x > 0))
    quoting = rows.where(F.exists("__lines", lambda x: x["level"] > 0)).select(*KEY, "__lines", F.explode(levels).alias("level"))
    quotes = quoting.select(*KEY, "level", F.explode(_hashes(quoted_at(F.col("level")))).alias("x")).select(*KEY, "level", "x.hash", "x.chars")
    quotes = saved(quotes, "chat-quotes")
    # only hashes that are quoted at all need their first writer
    asked = quotes.select("conv_id", "hash").distinct()
    first = wrote.join(asked, ["conv_id", "hash"], "left_semi").groupBy("conv_id", "hash").agg(F.min(F.struct("turn", (~F.col("whole")).alias("part"))).alias("x"))
    first = first.select("conv_id", "hash", F.col("x.turn").alias("source"), (~F.col("x.part")).alias("whole"))
    found = quotes.join(saved(first, "chat-first"), ["conv_id", "hash"]).where("source < turn")
    votes = found.groupBy(*KEY, "source", "level").agg(F.bool_or("whole").alias("whole"), F.sum("chars").alias("chars"), F.count("*").alias("matches"))
    best = F.max_by(F.struct("source", "matches"), F.struct(-F.col("level"), "whole", "chars", "matches", "source"))
    return votes.groupBy(*KEY).agg(best.alias("best")).select(*KEY, F.col("best.source").alias("reply_to"), F.col("best.matches").alias("matches"))


def threads(found: DataFrame) -> DataFrame:
    """conv_id, turn, reply_to, matches, thread, depth of linked messages, by doubling the known part of each
    chain of replies until all chains reach their beginning."""
    state = saved(found.select(*KEY, "reply_to", "matches", F.col("reply_to").alias("thread"), F.lit(1).cast("long").alias("depth"), F.lit(False).alias("ended")), "chat-threads")
    while not state.where("NOT ended").isEmpty():
        up = state.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("up_thread"), F.col("depth").alias("up_depth"))
        step = state.join(up, ["conv_id", "thread"], "left")
        state = saved(step.select(*KEY, "reply_to", "matches", F.coalesce("up_thread", "thread").alias("thread"), (F.col("depth") + F.coalesce("up_depth", F.lit(0))).alias("depth"), F.col("up_thread").isNull().alias("ended")), "chat-threads")
    return state.drop("ended")


def positions(keys: DataFrame) -> DataFrame:
    """conv_id, turn, position of distinct (conv_id, turn, thread, depth): the place of each in its conversation by
    thread, depth and turn. Rows are sorted by ranges and numbered where they lie; then only the sizes of partitions
    and the first number of each conversation are needed."""
    order = ["conv_id", "thread", "depth", "turn"]
    numbered = keys.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("number", F.monotonically_increasing_id())
    numbered = saved(numbered.withColumn("part", F.shiftright("number", 33)), "chat-order")
    sizes = numbered.groupBy("part").agg(F.count("*").alias("size"))  # a row for each partition
    before = F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = numbered.join(sizes.select("part", before.alias("before")), "part").select(*KEY, (F.col("before") + F.col("number").bitwiseAND((1 << 33) - 1)).alias("place"))
    first = placed.groupBy("conv_id").agg(F.min("place").alias("first"))
    return placed.join(first, "conv_id").select(*KEY, (F.col("place") - F.col("first")).alias("position"))


def reply_ordered(messages: DataFrame) -> DataFrame:
    """Each message with text (its own words), n_quoted_lines, max_level, reply_to, matches, thread, depth and
    position. In order of position, a conversation reads in order of reply, without its quotations."""
    added = ["n_quoted_lines", "max_level", "reply_to", "matches", "thread", "depth", "position"]
    rows = messages.drop(*added, "__lines")
    linked = threads(saved(links(rows), "chat-links"))
    keys = rows.select(*KEY).where("conv_id IS NOT NULL AND turn IS NOT NULL").distinct()
    known = keys.join(linked, KEY, "left").select(*KEY, "reply_to", F.coalesce("matches", F.lit(0)).cast("long").alias("matches"), F.coalesce("thread", "turn").alias("thread"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"))
    known = saved(known, "chat-known")
    place = known.join(positions(known.select(*KEY, "thread", "depth")), KEY)
    told = _with_lines(rows)
    told = told.withColumn("text", own_text(F.col("__lines"))).withColumn("n_quoted_lines", F.size(F.filter("__lines", lambda x: x["level"] > 0)).cast("long"))
    told = told.withColumn("max_level", F.array_max(F.transform("__lines", lambda x: x["level"])).cast("long")).drop("__lines")
    whole = told.join(place, KEY, "left")
    return whole.select(*[told[f"`{c}`"] for c in told.columns], "reply_to", F.coalesce("matches", F.lit(0)).cast("long").alias("matches"), F.coalesce("thread", told["turn"]).alias("thread"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), "position")
