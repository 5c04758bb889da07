"""The commands over a tree: init, status, diff, pull, commit.

A tree is a manifest, local files (path, text, hash), snapshots of the last sync (page_id, body) and a dialect. Reads of
remote pages come in as envelopes (page_id, text, pos), choices of people as tables. Every command returns tables, which
the caller publishes before the next one; only files whose link lines change are checkpointed here.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.functions import canon, extract, kernels
from canopy.functions import patterns as P
from canopy.operators import graph, ignore, links, merge, state
from canopy.sources.durable import settle


def process_fetch(envelopes: DataFrame, dialect: P.Dialect = P.DEFAULT) -> DataFrame:
    """Read records: page_id, title, body, remote_text, remote_hash, child_link_tags, has_children; of equal pages the last stays."""
    last = envelopes.groupBy("page_id").agg(F.max_by("text", "pos").alias("text"))
    parts = last.select("page_id", extract.body(F.col("text")).alias("body"), extract.title(F.col("text")).alias("title"))
    done = canon.canonical(parts, "body", "remote_text", "remote", F.coalesce("title", F.lit("")), dialect)
    children = extract.child_ids(F.col("body"), dialect)
    return done.select("page_id", "title", "body", "remote_text", canon.fingerprint(F.col("remote_text")).alias("remote_hash"), children.alias("child_link_tags"), (F.size(children) > 0).alias("has_children"))


def hash_batch(files: DataFrame, dialect: P.Dialect = P.DEFAULT) -> DataFrame:
    """path, text (canonical), hash of ``files(path, content, title)``; content is text."""
    done = canon.canonical(files, "content", "text", "local", F.coalesce("title", F.lit("")), dialect)
    return done.select("path", "text", canon.fingerprint(F.col("text")).alias("hash"))


@dataclass(frozen=True)
class Tree:
    manifest: DataFrame
    local: DataFrame
    snapshots: DataFrame
    root_id: str
    ignored: list[str] = field(default_factory=list)
    dialect: P.Dialect = P.DEFAULT

    @property
    def _skip(self):
        return ignore.ignored(F.col("path"), self.ignored)

    def with_ignore_flags(self) -> Tree:
        """local_ignored of every page as the patterns have it now."""
        return replace(self, manifest=ignore.with_ignored(self.manifest, self.ignored))

    def enumerate(self, links: DataFrame, most: int = 500) -> tuple[DataFrame, bool]:
        """All pages that ``links(src, dst)`` lead to from the root, and whether the search ended."""
        root = self.manifest.sparkSession.createDataFrame([(self.root_id,)], "page_id string")
        return graph.frontier_closure(links, root, most)

    def status(self, records: DataFrame) -> dict[str, DataFrame]:
        top = records.where(F.col("page_id") == self.root_id).select(F.explode("child_link_tags").alias("page_id"))
        found = graph.reachable(top, records)
        return {
            "states": state.status_classify(self.manifest, self.local, records),
            "untracked": state.untracked_local(self.manifest, self.local, self._skip),
            "missing": state.tracked_missing(self.manifest, self.local),
            "renames": state.rename_candidates(self.manifest, self.local),
            "renames_by_content": state.rename_candidates(self.manifest, self.local, "hash"),
            "remote_added": graph.remote_added(found, self.manifest),
            "remote_trashed": graph.remote_trashed(self.manifest, found, self.root_id, records),
            "ignored_tracked": state.ignored_tracked(self.manifest, self._skip),
        }

    def diff(self, prefixes: list[str] | None = None) -> DataFrame:
        """page_id, path, diff_text, ok, error for changed pages in scope, in natural order of their paths."""
        m = state.tracked(self.manifest).where(ignore.in_scope(F.col("path"), prefixes or []))
        rows = m.select("page_id", "path", "local_hash").join(self.local, "path", "left").join(self.snapshots.select("page_id", "body"), "page_id", "left")
        rows = rows.where(~F.col("local_hash").eqNullSafe(F.col("hash")))
        text = kernels.unified_diff(F.col("body"), F.col("text"))
        error = F.when(F.col("text").isNull(), "file missing").when(F.col("body").isNull(), "snapshot missing")
        return rows.select("page_id", "path", text.alias("diff_text"), error.isNull().alias("ok"), error.alias("error")).orderBy(graph.natural_key(F.col("path")))

    def pull(self, records: DataFrame, decisions: DataFrame, merged: DataFrame, now: str) -> tuple[Tree, DataFrame]:
        """Apply what was read; ``merged(page_id, merged_text, merged_hash)`` are texts that people merged.

        After that the link lines of pages in step and of those that took the remote text are brought up to date with
        their children, which moves no hash.
        """
        states = state.pull_classify(self.manifest, self.local, records)
        pages = self.manifest.select("page_id", "path", "title")
        bodies = records.select("page_id", "remote_text", "remote_hash").join(merged, "page_id", "left")
        done = merge.pull_apply(self.manifest, self.local, states, bodies, decisions, now, self.snapshots)
        acted = done.report.where(F.col("action").isin("stamp", "overwrite", "keep_remote")).select("page_id", "path", F.lit("clean").alias("state"))
        work = state.regeneration_list(acted, records)
        here = work.join(done.local.select("path", "text"), "path").select("page_id", "path", F.col("text").alias("body"))
        expected = work.select("page_id", F.posexplode("expected").alias("seq", "child"))
        new = links.regenerate(here, expected, pages, self.dialect)
        changed = new.join(here.select("page_id", F.col("body").alias("old")), "page_id").where(~F.col("body").eqNullSafe(F.col("old")))
        done = merge.rewrite_files(done, settle(changed.select("page_id", "path", "body")), now, self.dialect)
        return replace(self, manifest=done.manifest, local=done.local, snapshots=done.snapshots), done.report

    def commit_preflight(self) -> dict[str, DataFrame]:
        part = state.commit_partition(self.manifest, self.local, self._skip)
        new = state.new_page_parents(part.where("kind = 'new'").select("path"), self.manifest, self.root_id)
        return {"changes": part, "new": new, "batches": state.create_batches(new), "renames": state.rename_candidates(self.manifest, self.local)}

    def stale(self, records: DataFrame, forced: DataFrame | None = None) -> DataFrame:
        modified = state.commit_partition(self.manifest, self.local, self._skip).where("kind = 'modified'")
        return state.stale(modified, self.manifest, records, forced)

    def hunks(self, records: DataFrame, canonical: bool = True) -> DataFrame:
        """page_id, path, hunks for modified pages; a page whose remote text is missing has null hunks.

        ``canonical``: validate against the remote's canonical text, as the snapshot has it, or else against its body.
        Pages whose kept text still has to be pushed are compared with the remote text in place of the snapshot.
        """
        part = state.commit_partition(self.manifest, self.local, self._skip).where("kind = 'modified'").select("page_id", "path")
        part = part.join(self.manifest.select("page_id", state.pending(self.manifest).alias("unpushed")), "page_id")
        rows = part.join(self.local.select("path", "text"), "path").join(self.snapshots.select("page_id", F.col("body").alias("snapshot")), "page_id", "left")
        rows = rows.join(records.select("page_id", F.col("remote_text" if canonical else "body").alias("remote")), "page_id", "left")
        old = F.when(F.col("unpushed"), F.col("remote")).otherwise(F.col("snapshot"))
        plain = [canon.strip_child_links(c, self.dialect) for c in (old, F.col("text"))]
        return rows.select("page_id", "path", kernels.hunks(*plain, F.col("remote")).alias("hunks"))

    def commit(self, trash: DataFrame, modified: DataFrame, new: DataFrame, deleted: DataFrame, now: str) -> tuple[Tree, merge.Applied]:
        """Apply what was pushed, made and deleted, then fill in the placeholders whose pages there are now."""
        done = merge.commit_apply(self.manifest, trash, self.local, modified, new, deleted, now, self.snapshots)
        pages = done.manifest.select("page_id", "path", "title", "parent_page_id")
        parents = done.manifest.where("has_children").select("page_id", "path")
        here = parents.join(done.local.select("path", F.col("text").alias("body")), "path").select("page_id", "path", "body")
        filled = links.backfill(here, pages, self.root_id, self.dialect)
        changed = filled.join(here.select("page_id", F.col("body").alias("old")), "page_id").where(~F.col("body").eqNullSafe(F.col("old")))
        done = merge.rewrite_files(done, settle(changed.select("page_id", "path", "body")), None, self.dialect)
        return replace(self, manifest=done.manifest, local=done.local, snapshots=done.snapshots), done

    def verify(self) -> DataFrame:
        return state.mismatches(self.manifest, self.local)


def init(records: DataFrame, tree_pages: DataFrame, root_id: str, now: str, dialect: P.Dialect = P.DEFAULT) -> Tree:
    """A first tree from read records and ``tree_pages(page_id, parent_page_id, title, created_at)``."""
    paths = graph.tree_paths(tree_pages)
    pages = graph.has_children(tree_pages.select("page_id", "parent_page_id"))
    rows = records.select("page_id", F.coalesce("title", F.lit("")).alias("title"), "remote_text", "remote_hash").join(paths.select("page_id", "path"), "page_id").join(pages, "page_id")
    manifest = merge.init_seed(rows.withColumn("url", F.concat(F.lit(dialect.base_url), "page_id")), now)
    local = rows.select("path", F.col("remote_text").alias("text"), F.col("remote_hash").alias("hash"))
    return Tree(manifest, local, rows.select("page_id", F.col("remote_text").alias("body")), root_id, dialect=dialect)
