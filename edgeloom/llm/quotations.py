"""Chat formatting: reply order from quotations.

Lines with leading ``>`` marks are quotes, as deep as they have marks.  A message's own
lines and its whole own text are passages, and so are each quoted line and all quoted
text of one level.  Normalised passages are hashed, and a quoted one is joined to the
earliest message of the conversation that says it.  The best match (lowest level, then
most characters, then latest) is the message replied to.  Threads follow by pointer
doubling, and messages are range-sorted by conversation, thread and turn.

Only DataFrame functions are used.  Originals are one row per passage before the join, so
a common line does not meet itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, table

MARKS = r"^(?:[ \t]*>)+[ \t]?"


def normal(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(text), r"[\x20\x09-\x0D]+", " "))


def parse(text: Column) -> Column:
    """Array of (level, content) of a text's lines."""
    marks = lambda line: F.regexp_extract(line, MARKS, 0)
    return F.transform(F.split(text, "\n", -1), lambda x: F.struct(F.length(F.regexp_replace(marks(x), "[^>]", "")).alias("level"), F.regexp_replace(x, MARKS, "").alias("content")))


def _at(lines: Column, level: Column, sep: str) -> Column:
    return F.array_join(F.transform(F.filter(lines, lambda x: x["level"] == level), lambda x: x["content"]), sep)


def link_quotes(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text") -> DataFrame:
    """(row, conv, turn, text, n_quoted, parent_turn, thread, depth) for each message, in reply order.

    ``text`` is what the message says itself, ``parent_turn`` the turn that it quotes (null
    without one), ``thread`` the first turn of its chain of replies and ``depth`` its length.
    A message of quotes alone has an empty text; a null text stays null.  Messages without a
    conversation or turn are never linked.  Repeated turns share their links; a quote is never
    linked to a turn that is not earlier.  All columns of ``messages`` stay inside ``row``.
    """
    rows = messages.select(F.struct(*[F.col(c) for c in messages.columns]).alias("row"), F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), parse(F.col(text_col).cast("string")).alias("lines"))
    rows = rows.withColumn("text", F.btrim(_at(F.col("lines"), F.lit(0), "\n"), F.lit("\n")))
    rows = rows.withColumn("quotes", F.filter("lines", lambda x: x["level"] > 0))

    passage = lambda x: (F.xxhash64(x).alias("k1"), F.hash(x).alias("k2"))
    own = F.concat(F.transform(F.filter("lines", lambda x: x["level"] == 0), lambda x: normal(x["content"])), F.array(normal(F.col("text"))))
    keyed = rows.filter("conv is not null and turn is not null")
    said = keyed.select("conv", "turn", F.explode(F.array_distinct(own)).alias("p")).filter("p <> ''")
    originals = said.groupBy("conv", *passage("p")).agg(F.min("turn").alias("origin"))
    levels = F.array_distinct(F.transform("quotes", lambda x: x["level"]))
    quoted = F.concat(
        F.transform("quotes", lambda x: F.struct(x["level"].alias("level"), normal(x["content"]).alias("p"))),
        F.transform(levels, lambda n: F.struct(n.alias("level"), normal(_at(F.col("quotes"), n, " ")).alias("p"))),
    )
    asked = keyed.filter(F.size("quotes") > 0).select("conv", "turn", F.explode(F.array_distinct(quoted)).alias("q"))
    asked = asked.select("conv", "turn", F.col("q.level").alias("level"), F.length("q.p").alias("chars"), *passage("q.p")).filter("chars > 0").distinct()
    hits = asked.join(originals, ["conv", "k1", "k2"]).filter("origin < turn").groupBy("conv", "turn", "origin").agg(F.min("level").alias("level"), F.sum("chars").alias("chars"))
    best = F.struct((-F.col("level")).alias("a"), F.col("chars").alias("b"), F.col("origin").alias("c"))
    links = materialize(hits.groupBy("conv", "turn").agg(F.max(best).getField("c").alias("parent_turn")), "quote-links")

    # thread: the message reached by following links; depth: how many were followed.
    chains = links.select("conv", "turn", F.col("parent_turn").alias("thread"), F.lit(1).alias("depth"))
    while True:
        up = chains.select("conv", F.col("turn").alias("thread"), F.col("thread").alias("above"), F.col("depth").alias("more"))
        step = chains.join(up, ["conv", "thread"], "left").select("conv", "turn", F.coalesce("above", "thread").alias("thread"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("above").isNotNull().alias("moved"))
        step = materialize(step, "chains")
        chains = step.drop("moved")
        if step.filter("moved").limit(1).count() == 0:
            break
    linked = links.join(chains, ["conv", "turn"])
    out = rows.join(linked, ["conv", "turn"], "left")
    out = out.select("row", "conv", "turn", "text", F.coalesce(F.size("quotes"), F.lit(0)).alias("n_quoted"), "parent_turn", F.coalesce("thread", "turn").alias("thread"), F.coalesce("depth", F.lit(0)).alias("depth"))
    return out.orderBy("conv", "thread", "turn")


def op10_quotation_threads(spark, sf_dir: str) -> DataFrame:
    found = link_quotes(table(spark, sf_dir, "conversations"))
    return found.select(F.col("conv").alias("conv_id"), "turn", F.col("row.role").alias("role"), "text", F.col("n_quoted").cast("long").alias("n_quoted"), "parent_turn", "thread", F.col("depth").cast("long").alias("depth"))
