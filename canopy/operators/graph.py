"""Page graphs and page trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from canopy.functions import extract
from canopy.sources.durable import settle


def reachable(parent_links: DataFrame, records: DataFrame) -> DataFrame:
    """page_id of what the parent's body links to (``parent_links(page_id)``) or pages with children list."""
    listed = records.where("has_children").select(F.explode("child_link_tags").alias("page_id"))
    return parent_links.select("page_id").union(listed).select(F.lower("page_id").alias("page_id")).distinct()


def remote_added(found: DataFrame, manifest: DataFrame) -> DataFrame:
    return found.join(manifest.select("page_id"), "page_id", "left_anti")


def remote_trashed(manifest: DataFrame, found: DataFrame, root_id: str, read: DataFrame | None = None) -> DataFrame:
    """Pages of the manifest that nothing links to any more. ``read(page_id)``: only where their parent was read."""
    out = manifest.where(F.col("page_id") != root_id).join(found, "page_id", "left_anti")
    if read is not None:
        out = out.join(read.select(F.col("page_id").alias("parent_page_id")).distinct(), "parent_page_id", "left_semi")
    return out.select("page_id")


def frontier_closure(edges: DataFrame, roots: DataFrame, most: int = 500, compact_every: int = 3) -> tuple[DataFrame, bool]:
    """page_id, depth of all that ``edges(src, dst)`` lead to from ``roots(page_id)``, and whether the search ended.

    Each round visits the neighbours of the last round's pages that are new. It stops where none are, or after the
    round in which ``most`` pages are passed. Only pages of one round meet the edges, never all visited ones.
    """
    visited = settle(roots.select("page_id", F.lit(0).alias("depth")).distinct())
    last, depth = visited, 0
    while True:
        depth += 1
        step = edges.join(last.select(F.col("page_id").alias("src")), "src").select(F.col("dst").alias("page_id")).distinct()
        new = settle(step.join(visited.select("page_id"), "page_id", "left_anti").withColumn("depth", F.lit(depth)))
        count = new.count()
        if not count:
            return visited, True
        visited = visited.unionByName(new)
        if depth % compact_every == 0:
            visited = settle(visited)
        if most and visited.count() >= most:
            return visited, False
        last = new


def has_children(pages: DataFrame) -> DataFrame:
    """``pages(page_id, parent_page_id)`` plus whether another page names it as its parent."""
    parents = pages.where("parent_page_id IS NOT NULL").select(F.col("parent_page_id").alias("page_id"), F.lit(True).alias("has_children")).distinct()
    return pages.join(parents, "page_id", "left").withColumn("has_children", F.coalesce("has_children", F.lit(False)))


def slugs(pages: DataFrame) -> DataFrame:
    """``pages(page_id, parent_page_id, title, created_at)`` plus slug: siblings with the same one get -2, -3, ...

    A page that would be called index is counted as the second, since its parent's own file has that name.
    """
    named = pages.withColumn("slug", extract.slugify(F.col("title")))
    order = Window.partitionBy("parent_page_id", "slug").orderBy("created_at", "page_id")
    nth = F.row_number().over(order) + F.when(F.col("slug") == "index", 1).otherwise(0)
    return named.withColumn("nth", nth).withColumn("slug", F.when(F.col("nth") > 1, F.concat("slug", F.lit("-"), "nth")).otherwise(F.col("slug"))).drop("nth")


def tree_paths(pages: DataFrame) -> DataFrame:
    """page_id, path, depth by parents' folders: leaves are <slug>.md, others <slug>/index.md, the root index.md.

    One join a level, until a level is empty; pages on cycles or under unknown parents have no path and are left out.
    Only repeated page ids could lead into a cycle: beyond 64 levels they are an error.
    """
    named = has_children(slugs(pages)).select("page_id", "parent_page_id", "slug", "has_children")
    level = named.where("parent_page_id IS NULL").select("page_id", F.lit("").alias("folder"), F.lit("index.md").alias("path"), F.lit(0).alias("depth"))
    level = settle(level)
    out = level
    depth = 0
    while True:
        depth += 1
        if depth == 65 and named.groupBy("page_id").count().where("count > 1").limit(1).count():
            raise ValueError("page ids repeat, so the levels of the tree may never end")
        above = level.select(F.col("page_id").alias("parent_page_id"), F.col("folder").alias("up"))
        below = named.join(above, "parent_page_id")
        stem = F.concat("up", "slug")
        level = settle(
            below.select(
                "page_id",
                F.concat(stem, F.lit("/")).alias("folder"),
                F.when(F.col("has_children"), F.concat(stem, F.lit("/index.md"))).otherwise(F.concat(stem, F.lit(".md"))).alias("path"),
                F.lit(depth).alias("depth"),
            )
        )
        if not level.limit(1).count():
            break
        out = out.unionByName(level)
        if depth % 32 == 0:  # the plan of a deep tree stays small
            out = settle(out)
    return out.select("page_id", "path", "depth")


def create_waves(new: DataFrame, paths: DataFrame) -> DataFrame:
    """``new(page_id)`` in the order of creation: wave (depth), a folder's own page before its siblings."""
    placed = new.select("page_id").join(paths, "page_id")
    return placed.select("page_id", "path", F.col("depth").alias("wave"), F.endswith("path", F.lit("/index.md")).alias("folder_page"))


def natural_key(path):
    """Sort key under which numbers in paths count as numbers."""
    parts = F.regexp_extract_all(path, F.lit(r"[0-9]+|[^0-9]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.lpad(p, 20, "0")).otherwise(p)), "")
