"""Three-way comparison of a stored manifest with local files and remote records.

manifest(page_id, path, title, parent_page_id, url, local_hash, remote_hash, has_children, local_ignored, and perhaps
push_pending), local(path, hash), records(page_id, remote_hash, has_children, child_link_tags). Hashes compare
null-safely: a page without a file is changed locally. So is one whose kept or merged text still has to be pushed
(push_pending), whatever its hashes say. Joins are on page_id or path and carry hashes only, never texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from canopy.functions import extract


def tracked(manifest: DataFrame) -> DataFrame:
    return manifest.where(~F.coalesce("local_ignored", F.lit(False)))


def pending(manifest: DataFrame) -> Column:
    """Whether a page's text still has to be pushed."""
    return F.coalesce("push_pending", F.lit(False)) if "push_pending" in manifest.columns else F.lit(False)


def last_by_key(records: DataFrame, key: str = "page_id", order: str = "pos") -> DataFrame:
    """Of records with equal keys the last stays."""
    columns = [c for c in records.columns if c != key]
    return records.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("r")).select(key, *[F.col("r")[c].alias(c) for c in columns])


def _changes(manifest: DataFrame, local: DataFrame, records: DataFrame, how: str) -> DataFrame:
    m = tracked(manifest).select("page_id", "path", "local_hash", "remote_hash", pending(manifest).alias("unpushed"))
    seen = records.select("page_id", F.col("remote_hash").alias("new_remote"), F.lit(True).alias("read"))
    here = local.select("path", F.col("hash").alias("new_local"))
    joined = m.join(seen, "page_id", how).join(here, "path", "left")
    return joined.withColumns({"local_dirty": ~F.col("local_hash").eqNullSafe(F.col("new_local")) | F.col("unpushed"), "remote_moved": ~F.col("remote_hash").eqNullSafe(F.col("new_remote"))})


def pull_classify(manifest: DataFrame, local: DataFrame, records: DataFrame, illusory: bool = True) -> DataFrame:
    """page_id, path, state for pages that were read. ``illusory``: equal new contents on both sides are clean."""
    both = _changes(manifest, local, records, "inner")
    state = (
        F.when(F.lit(illusory) & F.coalesce(F.col("new_local") == F.col("new_remote"), F.lit(False)), "clean")
        .when(~F.col("local_dirty") & ~F.col("remote_moved"), "clean")
        .when(~F.col("local_dirty"), "auto_merge_remote")
        .when(~F.col("remote_moved"), "auto_merge_local")
        .otherwise("conflict")
    )
    return both.select("page_id", "path", state.alias("state"))


def status_classify(manifest: DataFrame, local: DataFrame, records: DataFrame) -> DataFrame:
    """page_id, path, state for all tracked pages, read or not."""
    both = _changes(manifest, local, records, "left")
    state = (
        F.when(F.col("read").isNull(), "untracked_remote_hash")
        .when(~F.col("local_dirty") & ~F.col("remote_moved"), "clean")
        .when(~F.col("local_dirty"), "modified_remote")
        .when(~F.col("remote_moved"), "modified_local")
        .otherwise("conflict")
    )
    return both.select("page_id", "path", state.alias("state"))


def illusory_conflicts(manifest: DataFrame, local: DataFrame, records: DataFrame) -> DataFrame:
    both = _changes(manifest, local, records, "inner")
    return both.where("local_dirty AND remote_moved AND new_local = new_remote").select("page_id", "path")


def state_counts(states: DataFrame) -> DataFrame:
    return states.groupBy("state").agg(F.count(F.lit(1)).alias("pages"))


def buckets(states: DataFrame, digits: int = 2) -> DataFrame:
    """state, bucket, page_ids (sorted): pages by state, in buckets by the first ``digits`` of their ids.

    A list for each state would gather a table in one row; more digits make smaller lists.
    """
    grouped = states.groupBy("state", F.substring("page_id", 1, digits).alias("bucket"))
    return grouped.agg(F.sort_array(F.collect_list("page_id")).alias("page_ids"))


def untracked_local(manifest: DataFrame, local: DataFrame, ignored: Column | None = None) -> DataFrame:
    out = local.join(manifest.select("path"), "path", "left_anti")
    return (out if ignored is None else out.where(~ignored)).select("path")


def tracked_missing(manifest: DataFrame, local: DataFrame) -> DataFrame:
    return tracked(manifest).join(local.select("path"), "path", "left_anti").select("page_id", "path")


def ignored_tracked(manifest: DataFrame, ignored: Column) -> DataFrame:
    return manifest.where(ignored).select("page_id", "path")


def rename_candidates(manifest: DataFrame, local: DataFrame, by: str = "basename") -> DataFrame:
    """page_id, old_path, new_path where one missing page and one unknown file fit each other, and no others.

    ``by``: basename, or hash (equal content).
    """
    here = local.select(F.col("path").alias("new_path"), F.col("hash").alias("new_hash"))
    joined = manifest.select("page_id", "path", "local_hash", "parent_page_id").join(here, F.col("path") == F.col("new_path"), "full")
    gone = F.col("new_path").isNull() & F.col("parent_page_id").isNotNull()
    new = F.col("path").isNull()
    old_key, new_key = (extract.basename(F.col("path")), extract.basename(F.col("new_path"))) if by == "basename" else (F.col("local_hash"), F.col("new_hash"))
    keyed = joined.where(gone | new).select(F.when(new, new_key).otherwise(old_key).alias("key"), "page_id", "path", "new_path").where("key IS NOT NULL")
    # one row a key: frequent names can't multiply
    once = keyed.groupBy("key").agg(
        F.count("path").alias("n_gone"), F.count("new_path").alias("n_new"), F.min("page_id").alias("page_id"), F.min("path").alias("old_path"), F.min("new_path").alias("new_path")
    )
    return once.where("n_gone = 1 AND n_new = 1").select("page_id", "old_path", "new_path")


def commit_partition(manifest: DataFrame, local: DataFrame, ignored: Column | None = None) -> DataFrame:
    """path, page_id, kind: modified, deleted or new. Pages whose text still has to be pushed are modified."""
    m = manifest.select("path", "page_id", "local_hash", F.coalesce("local_ignored", F.lit(False)).alias("skip"), pending(manifest).alias("unpushed"))
    unwanted = F.lit(False) if ignored is None else ignored
    here = local.select(F.col("path").alias("new_path"), "hash", unwanted.alias("unwanted"))
    joined = m.join(here, F.col("path") == F.col("new_path"), "full")
    fresh = F.col("path").isNull()
    kind = (
        F.when(fresh & F.col("unwanted"), F.lit(None))
        .when(fresh, "new")
        .when(F.col("skip"), F.lit(None))
        .when(F.col("new_path").isNull(), "deleted")
        .when(~F.col("hash").eqNullSafe(F.col("local_hash")) | F.col("unpushed"), "modified")
    )
    return joined.select(F.coalesce("path", "new_path").alias("path"), "page_id", kind.alias("kind")).where("kind IS NOT NULL")


def new_page_parents(new: DataFrame, manifest: DataFrame, root_id: str) -> DataFrame:
    """path, parent_page_id: the page whose index.md stands in the folder; for an index.md itself, one folder up."""
    folder = extract.dirname(F.col("path"))
    of = F.when(extract.basename(F.col("path")) == "index.md", extract.dirname(folder)).otherwise(folder)
    asked = new.select("path", F.when(of == "", F.lit("index.md")).otherwise(F.concat(of, F.lit("/index.md"))).alias("wanted"), (of == "").alias("top"))
    index = manifest.select(F.col("path").alias("wanted"), F.col("page_id").alias("found"))
    joined = asked.join(index, "wanted", "left")
    return joined.select("path", F.when(F.col("top"), F.lit(root_id)).otherwise(F.col("found")).alias("parent_page_id"))


def create_batches(new: DataFrame, size: int = 100) -> DataFrame:
    """``new(path, parent_page_id, wave)`` plus its batch: one parent, ``size`` pages at most, in the order of paths.

    ``wave``, if there is one, keeps batches apart: those of a wave are created before the next. The window holds the
    new pages of one parent, a list that people make.
    """
    order = Window.partitionBy("parent_page_id", *[c for c in ("wave",) if c in new.columns]).orderBy("path")
    return new.withColumn("batch", F.floor((F.row_number().over(order) - 1) / size).cast("long"))


def stale(modified: DataFrame, manifest: DataFrame, records: DataFrame, forced: DataFrame | None = None) -> DataFrame:
    """Modified pages whose remote has moved since the last sync; ``forced(page_id)`` are let through."""
    seen = records.select("page_id", F.col("remote_hash").alias("new_remote"))
    out = modified.select("page_id").join(manifest.select("page_id", "path", "remote_hash"), "page_id").join(seen, "page_id")
    out = out.where(~F.col("remote_hash").eqNullSafe(F.col("new_remote"))).select("page_id", "path")
    return out if forced is None else out.join(forced.select("page_id"), "page_id", "left_anti")


def fetch_list(manifest: DataFrame, local: DataFrame, scope: Column | None = None) -> DataFrame:
    """What to read: page_id, path, url, remote_hash, has_children, on_disk."""
    rows = tracked(manifest) if scope is None else tracked(manifest).where(scope)
    on = local.select("path", F.lit(True).alias("on_disk"))
    return rows.join(on, "path", "left").select("page_id", "path", "url", "remote_hash", "has_children", F.coalesce("on_disk", F.lit(False)).alias("on_disk"))


def refetch_list(states: DataFrame) -> DataFrame:
    """Pages whose bodies are needed, and why."""
    return states.where(F.col("state").isin("auto_merge_remote", "conflict")).select("page_id", F.col("state").alias("reason"))


def regeneration_list(states: DataFrame, records: DataFrame) -> DataFrame:
    """Clean pages with children, and the ids their link lines should have."""
    return states.where("state = 'clean'").join(records.where("has_children"), "page_id").select("page_id", "path", F.col("child_link_tags").alias("expected"))


def mismatches(manifest: DataFrame, local: DataFrame) -> DataFrame:
    """Pages whose file does not have the stored hash; empty after a good apply."""
    m = tracked(manifest).select("page_id", "path", "local_hash")
    return m.join(local.select("path", "hash"), "path").where(~F.col("hash").eqNullSafe(F.col("local_hash"))).select("page_id", "path")


def root_backfill_needed(root_id: str, manifest: DataFrame) -> DataFrame:
    root = manifest.sparkSession.createDataFrame([(root_id,)], "page_id string")
    return root.join(manifest.select("page_id"), "page_id", "left_anti")


PAGE_ID, HASH = "^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$", "^sha256:[0-9a-f]{64}$"
#: Of each kind of record the required columns and the optional ones, with their patterns (None: any value).
RECORDS = {
    "read": ({"page_id": PAGE_ID, "path": None, "remote_hash": HASH, "has_children": None, "child_link_tags": None}, {"manifest_remote_hash": None, "rich_blocks": None}),
    "write": ({"page_id": PAGE_ID, "path": None, "pushed": None, "warnings": None}, {"new_remote_hash": f"{HASH}|^$", "error": None}),
    "diff": ({"page_id": PAGE_ID, "path": None, "diff_text": None, "ok": None}, {"error": None}),
}


def valid_records(records: DataFrame, kind: str = "read", carried: tuple[str, ...] = ()) -> DataFrame:
    """``records`` plus problem: the first column that breaks a rule; null if none does.

    Required columns may not be null, values follow their patterns, and columns that the kind does not know (but for
    ``carried``) may hold nothing: they count as ``extra <name>``.
    """
    required, optional = RECORDS[kind]
    tests = []
    for c, pattern in {**required, **optional}.items():
        value = F.col(c) if c in records.columns else F.lit(None).cast("string")
        tests.append(F.when(value.isNull(), c in required).otherwise(F.lit(False) if pattern is None else ~value.rlike(pattern)))
    names = [*required, *optional]
    for c in records.columns:
        if c not in names and c not in carried:
            tests.append(F.col(c).isNotNull())
            names.append(f"extra {c}")
    first = F.array_position(F.array(*tests), F.lit(True)).cast("int")
    return records.withColumn("problem", F.when(first > 0, F.element_at(F.array(*[F.lit(n) for n in names]), first)))


def hash_duplicates(hashes: DataFrame) -> DataFrame:
    return hashes.groupBy("hash").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
