"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target: its share, by weight, of the words of all sources, stopped at ``most`` times its own
words, with the excess shared out again by weight until no target is above that stop. A source takes
``floor(target / words)`` whole copies of all its documents; the rest of its target comes from a sample without
replacement. Document i is to be included with a probability p_i in proportion to the square root of its size (between
equal chances and chances by size, so that neither short nor long documents crowd the mix), such that the expected words
are those wanted. Documents for which that is 1 or more are certain: they get one copy more, and the words left over are
shared out among the others in the same way, until no more become certain. Of the others the sample takes those of lowest
Pareto rank (u/(1-u)) / (p/(1-p)) with u uniform, one after the other, up to the first that doesn't fit the words
still wanted; then ``LAST`` times the next in rank that fits what is missing, the last time one that comes nearer to it. So the
sample's size in words is fixed, and near the target. u comes from a hash of id, size and
seed: runs agree.

No window sees a whole source: documents fall into bins by rank, the words of bins are summed, the one bin of a source
in which its sample ends is divided again, and only the one small bin left is put in order. Chances come from counts by
source and size. Sources are ranked by code point (null last) for their weights through range partitions.

Nulls: a null text has size 0, a null source is a source of its own, a null id hashes as itself. Documents of size 0
take 0 words. Rows equal in id, source and size share their draw: they are taken or left together. An empty table
gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from canopy.llm.shared import global_rank, materialize, pick

#: A source's ranks fall into so many bins, and the one in which its sample ends into as many again.
BINS, LEVELS = 1024, 2
#: So many documents are looked for, by rank, that fit what is missing in the end.
LAST = 4


def word_count(text):
    """Number of runs of characters other than blank and U+0009 to U+000D; null: 0."""
    text = F.replace(F.coalesce(text, F.lit("")), F.lit("\n"), F.lit(" "))
    text = F.when(text.rlike("[\t\x0b\x0c\r]"), F.translate(text, "\t\x0b\x0c\r", "    ")).otherwise(text)
    single = F.trim(F.when(F.contains(text, F.lit("  ")), F.regexp_replace(text, " +", " ")).otherwise(text))
    blanks = F.length(single) - F.length(F.replace(single, F.lit(" "), F.lit("")))
    return F.when(single == "", 0).otherwise(blanks + 1).cast("long")


def targets(sizes: DataFrame, weights: list[int], most: int) -> DataFrame:
    """``sizes(source, words)`` plus the target of each source, by water-filling.

    Each pass caps the sources that are above their stop and shares their excess; a pass gathers one row of sums.
    """
    ranked = materialize(global_rank(sizes, ["source"], "place", "sources"), "ranked")
    pick_weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = ranked.select("source", "words", pick_weight.alias("weight"))
    total = ranked.agg(F.sum("words").alias("t"), F.sum("weight").alias("w")).first()
    level = (total["t"] or 0) / total["w"] if total["w"] else 0.0
    capped, last = F.col("weight") * F.lit(level) >= F.col("words") * most, -1
    while True:
        row = ranked.agg(
            F.count(F.when(capped, 1)).alias("n"),
            F.sum(F.when(capped, F.col("words") * most)).alias("held"),
            F.sum(F.when(~capped, F.col("weight"))).alias("open"),
        ).first()
        if row["n"] == last or not row["open"]:
            break
        last = row["n"]
        level = (total["t"] - (row["held"] or 0)) / row["open"]
        capped = F.col("weight") * F.lit(level) >= F.col("words") * most
    goal = F.when(capped, (F.col("words") * most).cast("double")).otherwise(F.col("weight") * F.lit(float(level)))
    return ranked.select("source", "words", goal.alias("target"))


def _certain(plan: DataFrame, sizes: DataFrame) -> DataFrame:
    """``plan(s, wanted, ...)`` plus cut (the size from which documents are certain), rest (words wanted of the others) and tilt.

    ``sizes(source, size, n)``. Each pass gathers the sums of the documents below the cuts of the pass before.
    """
    plan = plan.withColumn("cut", F.lit((1 << 62)).cast("long"))
    while True:
        below = F.col("size") < F.col("cut")
        sums = (
            sizes.join(plan.select("s", "cut"), F.col("source").eqNullSafe(F.col("s")))
            .groupBy("source")
            .agg(F.sum(F.when(~below, F.col("size") * F.col("n"))).alias("sure"), F.sum(F.when(below, F.pow("size", F.lit(1.5)) * F.col("n"))).alias("tilt"))
            .select(F.col("source").alias("s2"), F.coalesce("sure", F.lit(0)).alias("sure"), F.coalesce("tilt", F.lit(0.0)).alias("tilt"))
        )
        now = plan.join(sums, F.col("s").eqNullSafe(F.col("s2")), "left").withColumn("rest", F.greatest(F.lit(0.0), F.col("wanted") - F.coalesce("sure", F.lit(0))))
        edge = F.when((F.col("rest") > 0) & (F.col("tilt") > 0), F.ceil(F.least(F.lit(2.0**62), F.pow(F.col("tilt") / F.col("rest"), F.lit(2.0))) - F.lit(1e-9)))
        now = materialize(now.withColumn("next", F.least("cut", F.coalesce(edge.cast("long"), "cut"))).drop("s2", "sure"), "certain")
        # a cut moves only where it meets another size
        moved = sizes.join(now.select("s", "cut", "next"), F.col("source").eqNullSafe(F.col("s"))).where("size >= next AND size < cut").limit(1).count()
        if not moved:
            return now.drop("next")
        plan = now.select(*[c for c in plan.columns if c != "cut"], F.col("next").alias("cut"))


def mix(
    docs: DataFrame,
    weights: list[int],
    most: int = 3,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    keep: list[str] | None = None,
) -> DataFrame:
    """Rows of ``docs`` with size, source_size, target, copies and taken (= copies * size).

    ``keep``: names for columns of ``docs`` to carry along, in their order; default: the id alone.
    """
    carried = {f"k{i}": c for i, c in enumerate(keep or [])}
    base = pick(docs, id=id_col, text=text_col, source=source_col, **carried)
    carried = list(carried)
    sized = base.select(F.col("id").alias("doc_id"), "source", word_count(F.col("text")).alias("size"), *carried)
    if not carried:
        sized = materialize(sized, "sizes")
    slim = sized.select("doc_id", "source", "size")
    sizes = materialize(slim.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "by-size")
    by_source = materialize(sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("words")), "by-source")
    goals = targets(by_source, weights, most)
    whole = F.when(F.col("words") > 0, F.floor(F.col("target") / F.col("words") + F.lit(1e-9))).otherwise(F.lit(0)).cast("long")
    plan = goals.select(F.col("source").alias("s"), "words", "target", whole.alias("whole"))
    plan = plan.withColumn("wanted", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("words")))
    plan = _certain(plan, sizes)
    sure = F.col("size") >= F.col("cut")
    chance = F.least(F.lit(1 - 1e-12), F.greatest(F.lit(1e-12), F.col("rest") * F.sqrt("size") / F.col("tilt")))
    draw = (F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size"), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    odds = (draw / (1 - draw)) / (chance / (1 - chance))
    joined = sized.join(plan, F.col("source").eqNullSafe(F.col("s")), "left").withColumns(
        {"sure": F.coalesce(sure, F.lit(False)), "at": F.when((F.col("rest") > 0) & (F.col("size") > 0) & ~sure, odds / (1 + odds))}
    )  # the rank, brought into 0 to 1
    ranked = materialize(joined.select("source", "size", F.col("rest").alias("wanted"), "at", "doc_id").where("at is not null"), "ranks")
    inside = ranked.withColumn("before", F.lit(0).cast("long"))
    for level in range(1, LEVELS + 1):
        cell = F.floor(F.col("at") * float(BINS**level)).cast("long")
        bins = inside.groupBy("source", cell.alias("bin")).agg(F.sum("size").alias("words"), F.first("wanted").alias("wanted"), F.first("before").alias("start"))
        run = Window.partitionBy("source").orderBy("bin")
        ends = (
            bins.withColumn("before", F.col("start") + F.sum("words").over(run) - F.col("words"))
            .where((F.col("before") <= F.col("wanted")) & (F.col("before") + F.col("words") > F.col("wanted")))
            .select(F.col("source").alias("es"), F.col("bin").alias("end_bin"), F.col("before").alias("end_before"))
        )
        ends = materialize(ends, "ends")  # a row a source at most
        inside = (
            inside.drop("before")
            .join(ends, F.col("source").eqNullSafe(F.col("es")) & (cell == F.col("end_bin")))
            .select("source", "size", "wanted", "at", "doc_id", F.col("end_before").alias("before"))
        )
    order = Window.partitionBy("source").orderBy("at", "doc_id", "size")
    last = (
        inside.withColumn("upto", F.col("before") + F.sum("size").over(order.rangeBetween(Window.unboundedPreceding, 0)))
        .where(F.col("upto") <= F.col("wanted"))
        .groupBy("source")
        .agg(F.max(F.struct("at", "doc_id", "size")).alias("lim"), F.max("upto").alias("upto"))
        .select(F.col("source").alias("ls"), "lim", "upto")
    )
    ones = F.array().cast("array<struct<at: double, doc_id: " + dict(ranked.dtypes)["doc_id"] + ", size: bigint>>")
    limits = ends.join(last, F.col("es").eqNullSafe(F.col("ls")), "left").select("es", "end_bin", "lim", F.coalesce("upto", "end_before").alias("upto"), ones.alias("ones"))
    limits = materialize(limits, "limits")
    cell = F.floor(F.col("at") * float(BINS**LEVELS)).cast("long")
    here = F.struct("at", "doc_id", "size")
    for n in range(LAST):
        left = (cell > F.col("end_bin")) | ((cell == F.col("end_bin")) & ~F.coalesce(here <= F.col("lim"), F.lit(False)))
        fits = ranked.join(limits, F.col("source").eqNullSafe(F.col("es"))).where(left & (F.col("size") < (F.col("wanted") - F.col("upto")) * (2 if n == LAST - 1 else 1)) & ~F.array_contains("ones", here))
        next_one = fits.groupBy("es").agg(F.min(here).alias("one")).select(F.col("es").alias("ns"), "one")
        found = limits.join(next_one, F.col("es").eqNullSafe(F.col("ns")), "left")
        added = F.when(F.col("one").isNotNull(), F.array("one")).otherwise(ones)
        limits = materialize(found.select("es", "end_bin", "lim", (F.col("upto") + F.coalesce("one.size", F.lit(0))).alias("upto"), F.concat("ones", added).alias("ones")), "limits")
    extra = (
        F.when(F.col("at").isNull(), False)
        .when(F.col("end_bin").isNull() | (cell < F.col("end_bin")), True)
        .when(cell > F.col("end_bin"), False)
        .otherwise(F.coalesce(here <= F.col("lim"), F.lit(False)))
    ) | F.coalesce(F.array_contains("ones", here), F.lit(False))
    out = joined.join(limits, F.col("source").eqNullSafe(F.col("es")), "left").withColumn("copies", F.col("whole") + (extra | F.col("sure")).cast("long"))
    return out.select("doc_id", "size", F.col("words").alias("source_size"), "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *carried)


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), [1, 2, 3]).drop("copies")
