"""Conversations without quotes, in the order of replies. DataFrame functions only.

A line's quote level is the number of ``>`` marks in front of it. The lines of level 0 are the message's own text; an attribution line ("On ...
wrote:") right before a deeper quote belongs to the quote. A passage is a run of lines of one level up to an empty line, an attribution or another level; its lines
are normalised (marks off, white space to one space, A-Z in lower case) and joined by one space, so a quotation may be wrapped anew, and cut into sentences.
Quoted sentences of at least ``MIN_CHARS`` characters are hashed and joined with the nearest earlier message of the same conversation that says the sentence itself.
A message replies to the message from which most of its level-1 sentences come (of equals the latest); following replies upwards gives its thread and depth, and
the order by (thread, depth, turn) its position in the conversation, where every message comes after the one that it answers.

Defined cases: null text is empty; a message that quotes nothing keeps its text as it is and starts a thread; messages with a null conv_id or turn are
linked with nothing and have no thread, depth or position; rows that share conv_id and turn are one message for links and stay separate rows; turns are whole numbers; of
sources with equally many sentences the latest counts; an empty table gives an empty table; other columns pass, save that one named like a result is replaced by it; a very
long text is parsed within its row, in time linear in its lines.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window, functions as F

from sluice.llm.scratch import Scratch

MIN_CHARS = 12
MARKS = r"^(?:[ \t]*>)+"
ATTRIBUTION = r"(?i)^[ \t>]*on\b.*\bwrote[ \t]*:[ \t\r]*$"
SPACES = "[\\x20\\x09-\\x0D\\x1C-\\x1F]+"
RESULTS = ["own_text", "n_quoted", "max_level", "n_linked", "reply_to", "thread", "depth", "position"]
_BLOCK = 8  #: turns are looked up in blocks of two to this power


def _level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 0), "[ \\t]", ""))


def _normal(line: Column) -> Column:
    bare = F.trim(F.regexp_replace(F.regexp_replace(line, MARKS, ""), SPACES, " "))
    return F.translate(bare, string.ascii_uppercase, string.ascii_lowercase)


def parsed(df: DataFrame, text: str) -> DataFrame:
    """Add ``__lines``: (level, said, line) structs; ``said``: the line isn't an attribution."""
    df = df.withColumn("__lines", F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1), lambda x: F.struct(_level(x).alias("level"), x.alias("line"))))
    deeper = lambda x, i: F.coalesce(F.get("__lines", i + 1)["level"] > x["level"], F.lit(False))
    return df.withColumn("__lines", F.transform("__lines", lambda x, i: F.struct(x["level"].alias("level"), (~(deeper(x, i) & x["line"].rlike(ATTRIBUTION))).alias("said"), x["line"].alias("line"))))


def sentences(rows: DataFrame) -> DataFrame:
    """(conv, turn, level, h1, h2) of each sentence that is long enough."""
    rows = rows.withColumn("__plain", F.transform("__lines", lambda x: F.struct(x["level"].alias("level"), F.when(x["said"], _normal(x["line"])).otherwise(F.lit("")).alias("s"))))
    before = lambda i: F.get("__plain", i - 1)
    goes_on = lambda x, i: F.coalesce((before(i)["level"] == x["level"]) & (before(i)["s"] != ""), F.lit(False))
    # Each line that begins a passage brings a mark and its level; no line holds the marks, as they count as white space.
    marked = F.transform("__plain", lambda x, i: F.when(x["s"] == "", F.lit("")).when(goes_on(x, i), F.concat(F.lit(" "), x["s"])).otherwise(F.concat(F.lit("\x1e"), x["level"].cast("string"), F.lit("\x1f"), x["s"])))
    each = rows.select("__conv", "__turn", F.explode(F.split(F.array_join(marked, ""), "\x1e")).alias("p")).where("p <> ''")
    cut = F.split(F.regexp_replace(F.substring_index("p", "\x1f", -1), "([.!?]) ", "$1\x1d"), "\x1d")
    each = each.select(F.col("__conv").alias("conv"), F.col("__turn").alias("turn"), F.substring_index("p", "\x1f", 1).cast("int").alias("level"), F.explode(cut).alias("s"))
    return each.where(F.length("s") >= MIN_CHARS).select("conv", "turn", "level", F.xxhash64("s").alias("h1"), F.xxhash64(F.lit("quote"), "s").alias("h2"))


def links(found: DataFrame) -> DataFrame:
    """(conv, turn, reply_to, n_linked): one row for each message with a linked quote; reply_to is null if none of its level-1 sentences is linked.

    The nearest earlier source is looked up by blocks of turns: a block knows its own turns and the last one before it, so neither a common sentence nor a long
    conversation makes pairs or meets in one task.
    """
    key = ["conv", "h1", "h2"]
    block = F.shiftright("turn", _BLOCK).alias("block")
    quoted = found.where("level > 0").groupBy("conv", "turn", "h1", "h2", "level").agg(F.count("*").alias("n"))
    asked = quoted.select(*key, block).distinct()
    said = found.where("level = 0").join(asked.select(*key).distinct(), key, "left_semi").groupBy(*key, block).agg(F.collect_set("turn").alias("turns"), F.max("turn").alias("last"))
    blocks = said.unionByName(asked, allowMissingColumns=True).groupBy(*key, "block").agg(F.first("turns", ignorenulls=True).alias("turns"), F.max("last").alias("last"))
    earlier = Window.partitionBy(*key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.max("last").over(earlier))
    source = F.coalesce(F.array_max(F.filter("turns", lambda t: t < F.col("turn"))), F.col("before"))
    linked = quoted.withColumn("block", block).join(blocks, [*key, "block"]).withColumn("source", source).where("source is not null")
    by = linked.groupBy("conv", "turn", "source").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("level") == 1, F.col("n"))).alias("n1"))
    top = F.max(F.when(F.col("n1").isNotNull(), F.struct("n1", "source")))
    return by.groupBy("conv", "turn").agg(top["source"].alias("reply_to"), F.sum("n").alias("n_linked"))


def threads(replies: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv, turn, thread, depth) of each message that replies: pointers double in each round, so rounds grow with the logarithm of the depth."""
    state = scratch.table(replies.where("reply_to is not null").select("conv", "turn", F.col("reply_to").alias("up"), F.lit(1).cast("long").alias("hops")), "threads")
    while not state.isEmpty():
        above = state.select("conv", F.col("turn").alias("up"), F.col("up").alias("up2"), F.col("hops").alias("hops2"))
        after = state.join(above, ["conv", "up"], "left").select("conv", "turn", F.coalesce("up2", "up").alias("up"), (F.col("hops") + F.coalesce("hops2", F.lit(0))).alias("hops"), F.col("up2").isNotNull().alias("moved"))
        state = scratch.table(after, "threads")
        if state.where("moved").isEmpty():
            break
        state = state.drop("moved")
    return state.select("conv", "turn", F.col("up").alias("thread"), F.col("hops").alias("depth"))


def positions(places: DataFrame, scratch: Scratch) -> DataFrame:
    """``places`` (conv, turn, thread, depth; one row a message) with ``position``: its rank in the conversation, from 0, by (thread, depth, turn).

    Rows are ranged over tasks and sorted; a rank is the rank in the task and what the conversation has in the tasks before, so a conversation may be of any length.
    """
    by = ["conv", "thread", "depth", "turn"]
    ordered = scratch.table(places.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("id", F.monotonically_increasing_id()), "ordered")
    ordered = ordered.withColumn("part", F.shiftright("id", 33))
    parts = ordered.groupBy("conv", "part").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("conv", "part", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return ordered.join(parts, ["conv", "part"]).select(*by, (F.col("before") + F.col("id") - F.col("first")).alias("position"))


def unquoted(df: DataFrame, *, conv: str = "conv_id", turn: str = "turn", text: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """``df`` with own_text, n_quoted (lines), max_level, n_linked (quoted sentences found in earlier messages), reply_to, thread, depth and position."""
    scratch = scratch or Scratch(df.sparkSession, "quotes")
    kept = [c for c in df.columns if c.lower() not in RESULTS]
    named = df.select(F.struct(*[F.col(f"`{c}`") for c in kept], F.lit(0).alias("__")).alias("__row"), F.col(conv).alias("__conv"), F.col(turn).cast("long").alias("__turn"), F.col(text).alias("__text"))
    known = named.where("__conv is not null and __turn is not null")
    found = scratch.table(links(scratch.table(sentences(parsed(known, "__text")), "sentences")), "links")
    paths = threads(found, scratch)
    messages = known.select(F.col("__conv").alias("conv"), F.col("__turn").alias("turn")).distinct()
    places = messages.join(found, ["conv", "turn"], "left").join(paths, ["conv", "turn"], "left")
    places = scratch.table(places.select("conv", "turn", "reply_to", F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), F.coalesce("thread", "turn").alias("thread"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth")), "places")
    ranked = positions(places.select("conv", "turn", "thread", "depth"), scratch).join(places.select("conv", "turn", "reply_to", "n_linked"), ["conv", "turn"])
    ranked = ranked.select(F.col("conv").alias("__c"), F.col("turn").alias("__t"), "thread", "depth", "position", "reply_to", "n_linked")
    out = known.join(ranked, (F.col("__conv") == F.col("__c")) & (F.col("__turn") == F.col("__t"))).drop("__c", "__t")
    alone = named.where("__conv is null or __turn is null").withColumn("n_linked", F.lit(0).cast("long"))
    rows = parsed(out.unionByName(alone, allowMissingColumns=True), "__text")
    own = F.transform(F.filter("__lines", lambda x: x["said"] & (x["level"] == 0)), lambda x: x["line"])
    levels = F.transform("__lines", lambda x: x["level"])
    made = {
        "own_text": F.when(F.array_max(levels) > 0, F.btrim(F.array_join(own, "\n"), F.lit(" \t\n\x0b\x0c\r"))).otherwise(F.coalesce(F.col("__text"), F.lit(""))),
        "n_quoted": F.size(F.filter(levels, lambda x: x > 0)).cast("long"),
        "max_level": F.array_max(levels).cast("long"),
    }
    return rows.select(*[F.col("__row")[c].alias(c) for c in kept], *[(made[c] if c in made else F.col(c)).alias(c) for c in RESULTS])
