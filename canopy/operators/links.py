"""Link lines: page tags rendered as links, placeholders filled in, and the links of a parent brought up to date.

Only ids and paths of link lines are exploded and joined, small rows all of them; what was found comes back as one list
for each page, and the text is rewritten within its row. So a text is moved once, to meet its list. Pages whose body is
null keep it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from canopy.functions import canon, extract, kernels
from canopy.functions import patterns as P

PAGE_TAG_LINE = r'(?i)^(\s*)<page\s+url="([^"]+)"(?:\s+icon="[^"]*")?\s*>([^<]*)</page>\s*$'


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _found(rows: DataFrame, key: str, *values: str) -> DataFrame:
    """``rows(page_id, key, values...)`` as one map a page: found, from the key to its values."""
    entries = F.collect_list(F.struct(F.col(key).alias("key"), F.struct(*values).alias("value")))
    return rows.groupBy("page_id").agg(F.map_from_entries(entries).alias("found"))


def substitute_page_tags(bodies: DataFrame, pages: DataFrame, dialect: P.Dialect = P.DEFAULT) -> DataFrame:
    """``bodies(page_id, path, body)`` with page-tag lines as managed links to ``pages(page_id, path)``."""
    target = lambda line: F.get(extract.ids(F.regexp_extract(line, PAGE_TAG_LINE, 2), dialect), F.lit(0))
    targets = F.array_distinct(F.array_compact(F.transform(F.filter(_lines(F.col("body")), lambda x: x.rlike(PAGE_TAG_LINE)), target)))
    asked = bodies.where(F.contains(F.lower("body"), F.lit("<page"))).select("page_id", F.explode(targets).alias("target"))
    to = pages.select(F.col("page_id").alias("target"), F.col("path").alias("target_path"))
    found = _found(asked.join(to, "target"), "target", "target_path")

    def link(line: Column) -> Column:
        to = F.try_element_at(F.col("found"), target(line))["target_path"]
        name = canon.trim_both(F.regexp_extract(line, PAGE_TAG_LINE, 3))
        return F.concat(F.regexp_extract(line, PAGE_TAG_LINE, 1), extract.managed_link(F.col("path"), target(line), name, to, dialect))

    rewritten = F.transform(_lines(F.col("body")), lambda x: F.when(x.rlike(PAGE_TAG_LINE) & target(x).isNotNull(), link(x)).otherwise(x))
    body = F.when(F.contains(F.lower("body"), F.lit("<page")), F.array_join(rewritten, "\n")).otherwise(F.col("body"))
    return bodies.select("page_id", "path", "body").join(found, "page_id", "left").select("page_id", "path", body.alias("body"))


def placeholders(bodies: DataFrame, pages: DataFrame, root_id: str, dialect: P.Dialect = P.DEFAULT) -> DataFrame:
    """page_id, path, pos, target, found (page id or null), good: the first of equal targets whose page is this page's child.

    ``pages(page_id, path, title, parent_page_id)``. Children of the root page's file name ``root_id`` as their parent.
    """
    hollow = "(?U)" + dialect.placeholder
    numbered = F.transform(_lines(F.col("body")), lambda x, i: F.struct(i.alias("pos"), canon.trim_both(x).alias("line")))
    rows = bodies.where(F.contains("body", F.lit("<!--"))).select("page_id", "path", F.inline(F.filter(numbered, lambda s: s["line"].rlike(hollow))))
    rows = rows.select("page_id", "path", "pos", extract.normal_path(extract.dirname(F.col("path")), F.regexp_extract("line", hollow, 1)).alias("target"))
    to = pages.select(F.col("path").alias("target"), F.col("page_id").alias("found"), F.col("title").alias("found_title"), F.col("parent_page_id").alias("found_parent"))
    own = pages.select("page_id", F.when(F.col("parent_page_id").isNull(), F.lit(root_id)).otherwise(F.col("page_id")).alias("own_id"))
    joined = rows.join(to, "target", "left").join(own, "page_id", "left")
    first = F.row_number().over(Window.partitionBy("page_id", "target").orderBy("pos")) == 1
    return joined.withColumn("good", F.coalesce((F.col("found_parent") == F.col("own_id")) & first, F.lit(False)))


def backfill(bodies: DataFrame, pages: DataFrame, root_id: str, dialect: P.Dialect = P.DEFAULT) -> DataFrame:
    """``bodies`` with good placeholders turned into managed links; the others stay as they are."""
    good = placeholders(bodies, pages, root_id, dialect).where("good")
    link = extract.managed_link(F.col("path"), F.col("found"), F.coalesce("found_title", F.lit("")), F.col("target"), dialect)
    found = _found(good.select("page_id", "pos", link.alias("new_line")), "pos", "new_line")
    filled = F.transform(_lines(F.col("body")), lambda x, i: F.coalesce(F.try_element_at(F.col("found"), i)["new_line"], x))
    body = F.when(F.col("found").isNotNull(), F.array_join(filled, "\n")).otherwise(F.col("body"))
    return bodies.select("page_id", "path", "body").join(found, "page_id", "left").select("page_id", "path", body.alias("body"))


def _child(line: Column, dialect: P.Dialect) -> Column:
    """The id that a managed line names; null for other lines."""
    return F.nullif(F.lower(F.regexp_extract(canon.trim_both(line), "(?U)" + dialect.managed, 1)), F.lit(""))


def regenerate(bodies: DataFrame, expected: DataFrame, pages: DataFrame, dialect: P.Dialect = P.DEFAULT) -> DataFrame:
    """page_id, path, body, added, dropped: managed lines of each body brought in line with ``expected(page_id, child, seq)``.

    Lines of expected children get their present title and path, other managed lines go. Missing children follow the
    last link or placeholder line, or else the last line that is not blank, in the order of seq.
    """
    want = expected.groupBy("page_id", F.lower("child").alias("child")).agg(F.min("seq").alias("seq"))
    to = pages.select(F.col("page_id").alias("child"), F.col("path").alias("child_path"), F.coalesce("title", F.lit("")).alias("child_title"))
    want = want.join(to, "child", "left").select("page_id", F.struct("seq", "child", "child_path", F.coalesce("child_title", F.lit("")).alias("child_title")).alias("w"))
    want = want.groupBy("page_id").agg(F.sort_array(F.collect_list("w")).alias("want"))
    rows = bodies.select("page_id", "path", "body").join(want, "page_id", "left")
    hollow = lambda x: canon.trim_both(x).rlike("(?U)" + dialect.placeholder)
    read = F.transform(_lines(F.col("body")), lambda x: F.struct(x.alias("x"), _child(x, dialect).alias("child"), hollow(x).alias("hollow")))
    rows = rows.select("page_id", "path", "body", "want", F.transform("want", lambda w: w["child"]).alias("ids"), read.alias("read"))
    fits = lambda s: s["child"].isNull() | F.coalesce(F.array_contains("ids", s["child"]), F.lit(False))
    rows = rows.withColumn("kept", F.filter("read", fits))
    link = lambda w: extract.managed_link(F.col("path"), w["child"], w["child_title"], w["child_path"], dialect)
    of = lambda s: F.get(F.col("want"), (F.array_position("ids", s["child"]) - 1).cast("int"))
    here = F.transform("read", lambda s: s["child"])
    places = lambda test: F.array_max(F.transform("kept", lambda s, i: F.when(test(s), i)))
    rows = rows.select(
        "page_id", "path", "body",
        F.transform("kept", lambda s: F.when(s["child"].isNotNull(), link(of(s))).otherwise(s["x"])).alias("lines"),
        F.coalesce(F.transform(F.filter("want", lambda w: ~F.coalesce(F.array_contains(here, w["child"]), F.lit(False))), link), F.array().cast("array<string>")).alias("new"),
        F.coalesce(places(lambda s: s["child"].isNotNull() | s["hollow"]), places(lambda s: ~canon.is_blank(s["x"])), F.size("kept") - 1).alias("last"),
        (F.size("read") - F.size("kept")).alias("dropped"),
    )
    lines = F.concat(F.slice("lines", F.lit(1), F.col("last") + 1), F.col("new"), F.slice("lines", F.col("last") + 2, F.size("lines")))
    there = F.col("body").isNotNull()
    return rows.select(
        "page_id",
        "path",
        F.when(there, F.array_join(lines, "\n")).alias("body"),
        F.when(there, F.size("new")).otherwise(0).cast("long").alias("added"),
        F.when(there, F.col("dropped")).otherwise(0).cast("long").alias("dropped"),
    )


def links_to_update(bodies: DataFrame, expected: DataFrame, dialect: P.Dialect = P.DEFAULT) -> DataFrame:
    """page_id of pages whose managed lines name other children than expected."""
    none = F.array().cast("array<string>")
    named = F.transform(_lines(F.col("body")), lambda x: _child(x, dialect))
    have = bodies.select("page_id", F.coalesce(F.array_sort(F.array_distinct(F.array_compact(named))), none).alias("have"))
    want = expected.groupBy("page_id").agg(F.array_sort(F.collect_set(F.lower("child"))).alias("want"))
    both = have.join(want, "page_id", "full")
    return both.where(F.coalesce("have", none) != F.coalesce("want", none)).select("page_id")


def rich_block_catalogue(bodies: DataFrame, text: Column) -> DataFrame:
    """page_id, seq, type, anchor, summary: rich blocks and image lines in order, each with the heading before it."""
    kernels.small_batches(bodies.sparkSession)
    rows = bodies.select("page_id", F.posexplode(kernels.rich_catalogue(text)).alias("seq", "b"))
    return rows.select("page_id", "seq", "b.type", "b.anchor", "b.summary")
