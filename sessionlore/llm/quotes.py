"""Operator 10: quotation linking, with DataFrame and SQL functions only.

Leading ``>`` marks (blanks between them allowed) give a line's quote level.
Runs of lines of one level form passages; level 0 is the message's own text.
Passages are normalised (lower case, white space collapsed), hashed, and
quoted ones are joined to the earliest message of the same conversation whose
own text has them: as its whole text, one of its runs or paragraphs, or one of its
lines. A message answers (``parent_turn``) the earlier message that most of its
level-1 lines come from; a whole passage counts more than lines. Messages
are returned without quotes, in reply order: a message, then each of its
replies with the replies to it, by turn. ``place`` comes from the parents alone:
sizes of subtrees and sums along the way up to the root by pointer doubling, so
in as many steps as the logarithm of the depth. :func:`conversations` joins the
messages in that order, in parts of ``BUCKET`` messages.

Nulls: a null text is empty. Rows with a null conv_id or turn are kept, link
with nothing, and have null places. Equal rows are one message (``copies``
says how many); different rows of one turn are ordered by role and text. An
empty table gives no rows. Very long texts stay one row; nothing collects
the messages of a conversation but in such parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionlore.llm.common import dropped, narrow, stored

#: Turns that share a bucket when places are counted, and messages of a part.
BUCKET = 64
MARKS = r"^[ \t]*((?:>[ \t]*)+)"
WROTE = r"(?i)^on .*\bwrote:[ \t]*$"


def normalised(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(text), r"[ \t\n\x0B\f\r]+", " "))


def digest(text: Column) -> Column:
    return F.md5(normalised(text))


def parsed(conversations: DataFrame) -> DataFrame:
    """Distinct messages with ``runs`` (level and text of each run of lines),
    and ``content``, the own text without quotes."""
    rows = narrow(conversations, "conv_id", "turn", "role", "text")
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies"))
    rows = rows.withColumn("raw", F.split(F.coalesce("text", F.lit("")), r"\r\n|\r|\n"))
    marks = lambda line: F.regexp_extract(line, MARKS, 1)
    rows = rows.withColumn("level", F.transform("raw", lambda x: F.length(F.regexp_replace(marks(x), "[^>]", ""))))
    # A line like "On Monday, X wrote:" right above a quote belongs to it.
    quoted_below = lambda i: F.coalesce(F.try_element_at("level", i + 2), F.lit(0)) > 0
    lines = F.transform("raw", lambda x, i: F.when((F.element_at("level", i + 1) == 0) & F.rlike(x, F.lit(WROTE)) & quoted_below(i), F.lit("")).otherwise(F.regexp_replace(x, MARKS, "")))
    rows = rows.withColumn("lines", lines)
    starts = F.filter(F.sequence(F.lit(1), F.size("level")), lambda i: (i == 1) | (F.element_at("level", i) != F.element_at("level", F.greatest(i - 1, F.lit(1)))))
    rows = rows.withColumn("starts", starts)
    run = lambda s, k: F.struct(
        F.element_at("level", s).alias("level"),
        F.array_join(F.slice("lines", s, F.coalesce(F.try_element_at("starts", k + 2), F.size("lines") + 1) - s), "\n").alias("text"),
    )
    rows = rows.withColumn("runs", F.transform("starts", run))
    own = F.array_join(F.transform(F.filter("runs", lambda r: r["level"] == 0), lambda r: r["text"]), "\n")
    return rows.withColumn("content", F.btrim(own, F.lit(" \t\n\r"))).select("conv_id", "turn", "role", "text", "copies", "runs", "content", F.array_max("level").alias("quote_levels"))


def originals(messages: DataFrame) -> DataFrame:
    """(conv_id, passage, origin): the earliest turn with each own passage."""
    own_runs = F.transform(F.filter("runs", lambda r: r["level"] == 0), lambda r: r["text"])
    units = F.array_distinct(F.transform(F.concat(F.array("content"), own_runs, F.split("content", r"\n[ \t]*\n"), F.split("content", "\n")), digest))
    return messages.where("conv_id is not null and turn is not null").select("conv_id", "turn", F.explode(units).alias("passage")).where(F.col("passage") != digest(F.lit(""))).groupBy("conv_id", "passage").agg(F.min("turn").alias("origin"))


def quotations(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, key, level, run, whole, passage): each quoted run, as a
    whole and as its lines. ``key`` tells different rows of one turn apart."""
    quoted = messages.where("quote_levels > 0 and conv_id is not null and turn is not null").select("conv_id", "turn", message_key().alias("key"), F.posexplode("runs").alias("run", "q")).where("q.level > 0")
    units = F.concat(F.array(F.struct(F.lit(True).alias("whole"), digest(F.col("q.text")).alias("passage"))), F.transform(F.split("q.text", "\n"), lambda x: F.struct(F.lit(False).alias("whole"), digest(x).alias("passage"))))
    return quoted.select("conv_id", "turn", "key", F.col("q.level").alias("level"), "run", F.explode(units).alias("u")).select("conv_id", "turn", "key", "level", "run", "u.whole", "u.passage").where(F.col("passage") != digest(F.lit("")))


def message_key() -> Column:
    return F.md5(F.to_json(F.struct("role", "text")))


def links(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, key, level, run, origin): the message that each quoted
    run comes from; null if none has it."""
    met = quotations(messages).alias("q").join(originals(messages).alias("o"), (F.col("q.conv_id") == F.col("o.conv_id")) & (F.col("q.passage") == F.col("o.passage")) & (F.col("o.origin") < F.col("q.turn")), "left").select("q.conv_id", "q.turn", "q.key", "q.level", "q.run", "q.whole", "o.origin")
    votes = met.groupBy("conv_id", "turn", "key", "level", "run", "origin").agg(F.max("whole").alias("whole"), F.count(F.lit(1)).alias("n"))
    best = F.max(F.when(F.col("origin").isNotNull(), F.struct(F.col("whole"), F.col("n"), (-F.col("origin")).alias("early"))))
    return votes.groupBy("conv_id", "turn", "key", "level", "run").agg((-best["early"]).alias("origin"), F.max("n").alias("n"), best["whole"].alias("whole"))


def before(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over the earlier turns of their key.
    Buckets of turns are summed first: a key's window holds buckets only."""
    bucketed = rows.withColumn("bucket", F.floor(F.col("turn") / BUCKET))
    totals = bucketed.groupBy(*keys, "bucket").agg(F.sum(value).alias("n"))
    earlier = totals.select(*keys, "bucket", (F.sum("n").over(Window.partitionBy(*keys).orderBy("bucket")) - F.col("n")).alias("earlier"))
    inside = F.sum(value).over(Window.partitionBy(*keys, "bucket").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)) - F.col(value)
    return bucketed.withColumn("inside", inside).join(earlier, [*keys, "bucket"]).withColumn(name, F.col("earlier") + F.col("inside")).drop("bucket", "inside", "earlier")


def with_sizes(turns: DataFrame) -> DataFrame:
    """``size`` of each turn (conv_id, turn, messages, parent_turn): messages in
    it and in all below it. Each step adds what is twice as far below, and goes on
    with the turns that have something twice as far above."""
    spark = turns.sparkSession
    active, path = stored(turns.where("parent_turn is not null").select("conv_id", "turn", F.col("messages").alias("size"), F.col("parent_turn").alias("up")), "subtrees")
    more, paths = turns.select("conv_id", "turn", F.lit(0).cast("long").alias("more")).limit(0), []
    while active.limit(1).count():
        below, below_path = stored(active.groupBy("conv_id", F.col("up").alias("turn")).agg(F.sum("size").alias("more")), "below")
        more, paths = more.unionByName(below), [*paths, below_path]
        above = active.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("next"))
        step = active.join(above, ["conv_id", "up"]).join(below, ["conv_id", "turn"], "left")
        active, new_path = stored(step.select("conv_id", "turn", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"), F.col("next").alias("up")), "subtrees")
        dropped(spark, path)
        path = new_path
    added = more.groupBy("conv_id", "turn").agg(F.sum("more").alias("more"))
    out, _ = stored(turns.join(added, ["conv_id", "turn"], "left").select("conv_id", "turn", "messages", "parent_turn", (F.col("messages") + F.coalesce("more", F.lit(0))).alias("size")), "sizes")
    dropped(spark, path, *paths)
    return out


def at_roots(steps: DataFrame) -> DataFrame:
    """``steps`` (conv_id, turn, root_turn, depth, first), whose root_turn is the
    parent, with the true root and the sums on the way to it. Pointers double;
    those that have arrived are set aside."""
    keep = ["conv_id", "turn", "root_turn", "depth", "first"]
    active, path = stored(steps.select(keep), "threads")
    done, paths = active.limit(0), [path]
    while True:
        every = done.unionByName(active)
        up = every.select("conv_id", F.col("turn").alias("root_turn"), F.col("root_turn").alias("next"), F.col("depth").alias("more"), F.col("first").alias("ahead"))
        met = active.join(up, ["conv_id", "root_turn"], "left")
        added = lambda c, x: (F.col(c) + F.coalesce(x, F.lit(0))).alias(c)
        step, path = stored(met.select("conv_id", "turn", F.coalesce("next", "root_turn").alias("root_turn"), added("depth", "more"), added("first", "ahead"), F.col("next").isNotNull().alias("moved")), "threads")
        done, active, paths = done.unionByName(step.where("not moved").select(keep)), step.where("moved").select(keep), [*paths, path]
        if not active.limit(1).count():
            out, _ = stored(done, "roots")
            dropped(steps.sparkSession, *paths)
            return out


def threads(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, root_turn, depth, first): ``first`` is the place of the
    turn's first message in the reply order of its conversation."""
    sized = with_sizes(turns)
    roots = before(sized.where("parent_turn is null"), ["conv_id"], "size", "first").select("conv_id", "turn", F.col("turn").alias("root_turn"), F.lit(0).alias("depth"), "first")
    replies = before(sized.where("parent_turn is not null"), ["conv_id", "parent_turn"], "size", "older")
    parents = sized.select("conv_id", F.col("turn").alias("parent_turn"), F.col("messages").alias("own"))
    # From a reply's parent to itself: the parent's messages and its earlier replies.
    steps = replies.join(parents, ["conv_id", "parent_turn"]).select("conv_id", "turn", F.col("parent_turn").alias("root_turn"), F.lit(1).alias("depth"), (F.col("own") + F.col("older")).alias("first"))

    below = at_roots(steps)
    starts = roots.select("conv_id", "root_turn", F.col("first").alias("start"))
    out = below.join(starts, ["conv_id", "root_turn"]).select("conv_id", "turn", "root_turn", "depth", (F.col("start") + F.col("first")).alias("first")).unionByName(roots)
    return stored(out, "reply-order")[0]


def linked_conversations(conversations: DataFrame) -> DataFrame:
    """One row per message, see above."""
    messages, _ = stored(parsed(conversations), "messages")
    found, found_path = stored(links(messages), "quote-links")
    per_message = found.groupBy("conv_id", "turn", "key").agg(
        F.count(F.lit(1)).alias("n_quotes"),
        F.count("origin").alias("n_linked"),
        F.max(F.when((F.col("level") == 1) & F.col("origin").isNotNull(), F.struct("whole", "n", (-F.col("origin")).alias("early")))).alias("best"),
    ).select("conv_id", "turn", "key", "n_quotes", "n_linked", (-F.col("best.early")).alias("parent_turn"))
    per_message, _ = stored(per_message, "parents")
    dropped(conversations.sparkSession, found_path)
    counts = messages.where("conv_id is not null and turn is not null").groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("messages"))
    parents = per_message.where("parent_turn is not null").groupBy("conv_id", "turn").agg(F.min("parent_turn").alias("parent_turn"))
    order = threads(counts.join(parents, ["conv_id", "turn"], "left"))
    rank = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text"))
    # Rows without a conversation or a turn meet nothing: they stay out of windows and joins.
    keyed = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    placed = messages.where(keyed).withColumn("key", message_key()).withColumn("rank", rank)
    out = placed.join(per_message, ["conv_id", "turn", "key"], "left").join(order, ["conv_id", "turn"], "left")
    out = out.unionByName(messages.where(~keyed), allowMissingColumns=True)
    role = F.coalesce("role", F.lit("unknown"))
    return out.select(
        "conv_id", "turn", "role", (F.col("first") + F.col("rank") - 1).alias("place"), "copies", "quote_levels",
        F.coalesce("n_quotes", F.lit(0)).alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"), "parent_turn",
        F.coalesce("root_turn", "turn").alias("root_turn"), F.coalesce("depth", F.lit(0)).alias("depth"),
        F.concat(F.lit("<|"), role, F.lit("|>\n"), F.col("content"), F.lit("\n<|end|>")).alias("formatted"),
    )


def conversations(messages: DataFrame, size: int = BUCKET) -> DataFrame:
    """(conv_id, part, n_messages, n_quotes, n_linked, replies, conversation) of
    rows of :func:`linked_conversations`: a conversation's text in reply order,
    ``size`` messages a part. ``replies`` names turn, parent and depth of each
    message. A message without a place is a part of its own, number -1."""
    line = F.concat(F.coalesce(F.col("turn").cast("string"), F.lit("?")), F.lit("<"), F.coalesce(F.col("parent_turn").cast("string"), F.lit("-")), F.lit("/"), F.col("depth").cast("string"))
    rows = messages.select("conv_id", "place", "n_quotes", "n_linked", line.alias("line"), "formatted")
    loose = rows.where("place is null").select("conv_id", F.lit(-1).cast("long").alias("part"), F.lit(1).cast("long").alias("n_messages"), "n_quotes", "n_linked", F.col("line").alias("replies"), F.col("formatted").alias("conversation"))
    parts = rows.where("place is not null").groupBy("conv_id", F.floor(F.col("place") / size).cast("long").alias("part")).agg(
        F.count(F.lit(1)).alias("n_messages"), F.sum("n_quotes").alias("n_quotes"), F.sum("n_linked").alias("n_linked"), F.array_sort(F.collect_list(F.struct("place", "line", "formatted"))).alias("xs")
    )
    joined = parts.select("conv_id", "part", "n_messages", "n_quotes", "n_linked", F.array_join(F.col("xs.line"), ",").alias("replies"), F.array_join(F.col("xs.formatted"), "\n").alias("conversation"))
    return joined.unionByName(loose)


def quoting(conversations: DataFrame) -> DataFrame:
    """The conversations as mail: a turn quotes an earlier one before its own
    text, whole or by its first line. Chat tables have no quotes by themselves."""
    rows = narrow(conversations, "conv_id", "turn", "role", "text")
    quoted = rows.groupBy("conv_id", F.col("turn").alias("source")).agg(F.min("text").alias("quoted"))
    source = F.greatest(F.col("turn") - 1 - F.col("turn") % 3, F.lit(0))
    met = rows.withColumn("source", F.when(F.col("turn") > 0, source)).join(quoted, ["conv_id", "source"], "left")
    part = F.when(F.col("turn") % 2 == 0, F.col("quoted")).otherwise(F.substring_index("quoted", "\n", 1))
    mail = F.concat(F.lit("On Monday, someone wrote:\n> "), F.replace(part, F.lit("\n"), F.lit("\n> ")), F.lit("\n\n"), F.coalesce("text", F.lit("")))
    return met.select("conv_id", "turn", "role", F.when(F.coalesce("quoted", F.lit("")) != "", mail).otherwise(F.col("text")).alias("text"))
