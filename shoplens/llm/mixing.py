"""Mixing sources to target weights by entropy balancing, in column expressions only.

Every document gets a rate, the expected number of its copies in the mix. Of all rates in
0 .. MOST that meet each source's word target, those are taken that stay nearest to 1 in
relative entropy. Their dual is convex with one variable l for each source, and the rates are
exponential tilts of the document's size z (in mean sizes of its source):

    rate = MOST / (1 + (MOST - 1) * exp(-l * z)),  which is 1 for l = 0.

Safeguarded Newton steps find l for all sources at once. A step reads the histogram of
(source, size), not the documents, and aggregates by source; the state is a table by source,
written to the shared folder after each step.

Rounding: all documents of one source and size share a rate, so their copies are rounded
together; what a source then lacks or has too much is settled on the largest sizes that fit,
down to the smallest. Within a source and size the extra copies go to the documents of lowest
hash. Groups are dealt out by a salt of the id, so one that holds a third of all rows is
many groups.

Targets: sources by code point, null last, weigh 1, 2, 3, 1, ...; they share all words, none
gets over MOST times its own, what is above goes to the others by weight.

Defined results: a null text has size 0; documents of size 0 are taken once and count nothing. An
empty table gives an empty mix. Rows with equal doc_id, source and size are taken alike.
Reruns agree: ranks come from hashes, and l is cut to 9 digits before rates are rounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoplens.llm.common import staged

WORD = r"[^\x20\x09-\x0D]+"
#: most copies of a document, and most words of a source's target in multiples of its own
MOST = 3
SALTS = 64
#: Newton ends when each source is this near to its target (relative), or after so many steps
NEAR, STEPS = 1e-9, 60
SETTLING_ROUNDS = 5


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, salt) of ``docs`` (doc_id, source, text)."""
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"),
                       F.pmod(F.xxhash64(F.lit("salt"), "doc_id"), F.lit(SALTS)).alias("salt"))


def targets(histogram: DataFrame) -> DataFrame:
    """(source, source_size, mean_size, target) from a histogram (source, size, n).

    The shares fill up like water: sources that reach MOST times their own words do so in the
    order of that bound per weight, and the others share what is left. One row a source.
    """
    own = histogram.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"),
                                          F.sum("n").alias("docs"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = own.withColumn("weight", (F.row_number().over(by_name) - 1) % 3 + 1) \
        .withColumn("most", MOST * F.col("source_size"))
    by_bound = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    before = by_bound.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0))) \
        / F.sum("weight").over(by_bound.rowsBetween(0, Window.unboundedFollowing))
    filled = weighed.withColumn("level", level) \
        .withColumn("open", F.when(F.col("most") / F.col("weight") > F.col("level"), F.col("level")))
    # the level of the first source that stays below its bound holds for all that do
    final = F.first("open", ignorenulls=True).over(
        by_bound.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return filled.select("source", "source_size", (F.col("source_size") / F.col("docs")).alias("mean_size"),
                         F.least(F.col("most").cast("double"), F.coalesce(F.col("weight") * final, F.col("most")))
                         .alias("target"))


def rate(tilt: Column, size: Column, mean_size: Column) -> Column:
    z = F.when(mean_size > 0, size / mean_size).otherwise(F.lit(0.0))
    return F.lit(float(MOST)) / (1 + (MOST - 1) * F.exp(F.greatest(F.lit(-700.0), F.least(F.lit(700.0), -tilt * z))))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def tilts(histogram: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (see targets) with ``tilt``; sources whose target is their bound need none."""
    state = wanted.withColumnRenamed("source", "of").select(
        "*", F.lit(0.0).alias("tilt"), F.lit(-1e6).alias("lo"), F.lit(1e6).alias("hi"),
        (F.col("target") < MOST * F.col("source_size")).alias("open"))
    state = staged(state, "mix-tilts")
    for _ in range(STEPS):
        r = rate(F.col("tilt"), F.col("size"), F.col("mean_size"))
        z = F.col("size") / F.col("mean_size")
        words = F.col("n") * F.col("size")
        sums = histogram.join(state.where("open"), _same("source", "of")).groupBy("source").agg(
            F.sum(words * r).alias("got"), F.sum(words * z * r * (1 - r / MOST)).alias("slope"))
        off = F.col("got") - F.col("target")
        lo = F.when(off < 0, F.col("tilt")).otherwise(F.col("lo"))
        hi = F.when(off > 0, F.col("tilt")).otherwise(F.col("hi"))
        newton = F.col("tilt") - F.greatest(F.lit(-2.0), F.least(F.lit(2.0), F.coalesce(
            F.try_divide(off, F.col("slope")), F.signum(off) * 2)))
        step = state.join(sums, _same("of", "source"), "left").select(
            "of", "source_size", "mean_size", "target", "tilt", "open", "got",
            lo.alias("lo"), hi.alias("hi"), newton.alias("newton"))
        near = F.abs(F.col("got") - F.col("target")) <= NEAR * F.col("target")
        inside = (F.col("newton") > F.col("lo")) & (F.col("newton") < F.col("hi"))
        moved = F.when(inside, F.col("newton")).otherwise((F.col("lo") + F.col("hi")) / 2)
        go_on = F.col("open") & ~near
        state = staged(step.select("of", "source_size", "mean_size", "target",
                                   F.when(go_on, moved).otherwise(F.col("tilt")).alias("tilt"), "lo", "hi",
                                   go_on.alias("open")), "mix-tilts")
        if state.where("open").isEmpty():
            break
    return state.select(F.col("of").alias("source"), "source_size", "mean_size", "target", "tilt")


def rounded(histogram: DataFrame, tilted: DataFrame) -> DataFrame:
    """(source, size, n, copies, source_size, target): copies of all documents of a source and size."""
    r = F.when(F.col("target") >= MOST * F.col("source_size"), F.lit(float(MOST))) \
        .otherwise(rate(F.round("tilt", 9), F.col("size"), F.col("mean_size")))
    r = F.when(F.col("size") == 0, F.lit(1.0)).otherwise(r)
    now = histogram.join(tilted.withColumnRenamed("source", "of"), _same("source", "of")).select(
        "source", "size", "n", "source_size", "target", F.floor(F.col("n") * r + 0.5).alias("copies"))
    by_source = Window.partitionBy("source")
    for _ in range(SETTLING_ROUNDS):
        off = (F.round(F.col("target")).cast("long") - F.sum(F.col("copies") * F.col("size")).over(by_source))
        now = now.withColumn("off", off)
        room = F.when(F.col("off") > 0, MOST * F.col("n") - F.col("copies")).otherwise(F.col("copies"))
        room = F.when((F.col("size") > 0) & (F.col("size") <= F.abs("off")), room).otherwise(F.lit(0))
        now = now.withColumn("room", room)
        before = F.coalesce(F.sum(F.col("room") * F.col("size")).over(
            by_source.orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        now = now.withColumn("left", F.greatest(F.lit(0), F.abs("off") - before))
        moved = F.least(F.col("room"), F.expr("`left` div greatest(size, 1)"))
        now = now.select("source", "size", "n", "source_size", "target",
                         (F.col("copies") + F.signum("off").cast("long") * moved).alias("copies"))
    return now


def mixed(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for each row of ``docs``
    (doc_id, source, text): the words of its source, that source's target, how often the row
    is taken, and the words that makes."""
    rows = staged(sized(docs), "mix-sizes")
    salted = staged(rows.groupBy("source", "size", "salt").agg(F.count("*").alias("rows")), "mix-salted")
    histogram = staged(salted.groupBy("source", "size").agg(F.sum("rows").alias("n")), "mix-histogram")
    wanted = staged(targets(histogram), "mix-targets")
    groups = staged(rounded(histogram, tilts(histogram, wanted)), "mix-copies")
    # the extra copies of a group, dealt out to its salts in proportion
    groups = groups.withColumnsRenamed({"source": "s", "size": "z"})
    in_group = Window.partitionBy("source", "size").orderBy("salt")
    upto = F.sum("rows").over(in_group)
    extra = F.col("copies") % F.col("n")
    shares = salted.withColumn("upto", upto).join(groups, _same("source", "s") & (F.col("size") == F.col("z"))).select(
        F.col("source").alias("s"), F.col("size").alias("z"), F.col("salt").alias("t"), "source_size", "target",
        F.expr("copies div n").alias("each"),
        (F.floor(extra * F.col("upto") / F.col("n")) - F.floor(extra * (F.col("upto") - F.col("rows")) / F.col("n")))
        .alias("extra"))
    draw = F.rank().over(Window.partitionBy("source", "size", "salt").orderBy(F.xxhash64(F.lit("draw"), "doc_id"), "doc_id"))
    copies = F.col("each") + F.when(F.col("draw") <= F.col("extra"), 1).otherwise(0)
    return rows.withColumn("draw", draw) \
        .join(shares, _same("source", "s") & (F.col("size") == F.col("z")) & (F.col("salt") == F.col("t"))) \
        .select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"),
                (copies * F.col("size")).alias("taken"))
