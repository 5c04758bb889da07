import dataclasses

from pyspark.sql import functions as F

from canopy import api
from canopy.functions import sql
from canopy.sources.durable import settle

R, A, B = (f"{c * 8}-0000-0000-0000-000000000000" for c in "123")


def envelope(title, body):
    return f'<page url="x"><properties>{{"title":"{title}"}}</properties>\n<content>\n{body}\n</content></page>'


def page(of):
    return f'<page url="https://wiki.example/{of.replace("-", "")}">c</page>'


def published(tree):
    """As between two commands: the tables are written and read again."""
    return dataclasses.replace(tree, manifest=settle(tree.manifest), local=settle(tree.local), snapshots=settle(tree.snapshots))


def start(spark):
    read = spark.createDataFrame([(R, envelope("Root", page(A) + "\n" + page(B)), 0), (A, envelope("A", "boil\npour\nwait"), 1), (B, envelope("B", "one\ntwo"), 2)], "page_id string, text string, pos int")
    pages = spark.createDataFrame([(R, None, "Root", 0), (A, R, "A", 1), (B, R, "B", 2)], "page_id string, parent_page_id string, title string, created_at long")
    records = api.process_fetch(read).cache()
    tree = api.init(records, pages, R, "t0")
    return records, published(tree)


def test_round_of_commands(spark):
    records, tree = start(spark)
    status = tree.status(records)
    assert {r.state for r in status["states"].collect()} == {"clean"}
    assert all(status[k].count() == 0 for k in status if k != "states")
    files = spark.createDataFrame([("index.md", "", ""), ("a.md", "boil\nstir\nwait\n", ""), ("new/x.md", "# X\n", ""), ("top.md", "t", "")], "path string, content string, title string")
    edited = dataclasses.replace(tree, local=api.hash_batch(files).cache(), ignored=["top.md"])
    status = edited.status(records)
    assert {r.page_id: r.state for r in status["states"].collect()} == {R: "clean", A: "modified_local", B: "modified_local"}
    assert [r.path for r in status["untracked"].collect()] == ["new/x.md"] and [r.path for r in status["missing"].collect()] == ["b.md"]
    diffs = {r.path: r for r in edited.diff().collect()}
    assert "-pour\n+stir\n" in diffs["a.md"].diff_text and diffs["b.md"].error == "file missing"
    assert edited.diff(["b"]).count() == 1
    pre = edited.commit_preflight()
    assert {(r.path, r.kind) for r in pre["changes"].collect()} == {("a.md", "modified"), ("b.md", "deleted"), ("new/x.md", "new")}
    assert [tuple(r) for r in pre["new"].collect()] == [("new/x.md", None)]
    assert edited.stale(records).count() == 0
    (h,) = edited.hunks(records).where(F.col("page_id") == A).first().hunks
    assert (h.verdict, h.old_str, h.new_str) == ("ok", "boil\npour\nwait\n", "boil\nstir\nwait\n")
    new_hash = edited.local.where("path = 'a.md'").first().hash
    trash = spark.createDataFrame([], "page_id string, path string, trashed_at string, trashed_by string, title string, last_local_hash string")
    pushed = spark.createDataFrame([(A, True, new_hash, None), ("nobody", True, "h", None)], "page_id string, pushed boolean, new_remote_hash string, error string")
    after, done = edited.commit(trash, pushed, tree.manifest.limit(0), spark.createDataFrame([(B, "M")], "page_id string, choice string"), "t1")
    after = published(after)
    assert [(r.page_id, r.trashed_by) for r in done.trash.collect()] == [(B, "untracked-no-remote-action")]
    assert [(r.page_id, r.error) for r in done.report.collect()] == [("nobody", "unknown page")]
    assert after.verify().count() == 0 and after.manifest.count() == 2
    assert {r.page_id: r.body for r in after.snapshots.collect()}[A] == "boil\nstir\nwait\n"


def test_pull_takes_remote_edits(spark):
    _, tree = start(spark)
    moved = api.process_fetch(spark.createDataFrame([(A, envelope("A", "boil\nserve"), 0)], "page_id string, text string, pos int")).cache()
    none = spark.createDataFrame([], "page_id string, choice string, pos int")
    merged = spark.createDataFrame([], "page_id string, merged_text string, merged_hash string")
    after, report = tree.pull(moved, none, merged, "t1")
    after = published(after)
    assert [(r.page_id, r.action) for r in report.collect()] == [(A, "overwrite")]
    assert after.local.where("path = 'a.md'").first().text == "boil\nserve\n"
    assert after.verify().count() == 0
    assert after.with_ignore_flags().manifest.where("local_ignored").count() == 0


def test_kept_text_is_pushed_and_not_overwritten(spark):
    _, tree = start(spark)
    files = spark.createDataFrame([("a.md", "boil\nstir\nwait\n", "A"), ("b.md", "one\ntwo\n", "B"), ("index.md", "", "Root")], "path string, content string, title string")
    edited = dataclasses.replace(tree, local=api.hash_batch(files).cache())
    moved = api.process_fetch(spark.createDataFrame([(A, envelope("A", "boil\nserve\nwait"), 0)], "page_id string, text string, pos int")).cache()
    keep = spark.createDataFrame([(A, "L", 0)], "page_id string, choice string, pos int")
    merged = spark.createDataFrame([], "page_id string, merged_text string, merged_hash string")
    once, report = edited.pull(moved, keep, merged, "t1")
    once = published(once)
    assert [(r.page_id, r.action) for r in report.collect()] == [(A, "keep_local")]
    assert [(r.page_id, r.kind) for r in once.commit_preflight()["changes"].collect()] == [(A, "modified")]
    (h,) = once.hunks(moved).first().hunks  # remote to local, as the snapshot is the local text already
    assert (h.verdict, h.new_str) == ("ok", "boil\nstir\nwait\n") and "serve" in h.old_str
    twice, report = once.pull(moved, keep.limit(0), merged, "t2")
    twice = published(twice)
    assert report.count() == 0 and twice.local.where("path = 'a.md'").first().text == "boil\nstir\nwait\n"
    pushed = spark.createDataFrame([(A, True, twice.local.where("path = 'a.md'").first().hash, None)], "page_id string, pushed boolean, new_remote_hash string, error string")
    trash = spark.createDataFrame([], "page_id string, path string, trashed_at string, trashed_by string, title string, last_local_hash string")
    done, _ = twice.commit(trash, pushed, tree.manifest.limit(0), spark.createDataFrame([], "page_id string, choice string"), "t3")
    done = published(done)
    assert done.commit_preflight()["changes"].count() == 0


def test_pull_brings_link_lines_up_to_date(spark):
    records, tree = start(spark)
    line = lambda title, name, of: f'[{title}](./{name}.md) <!-- tree:child page_id="{of}" -->'
    linked = tree.local.withColumn("text", F.when(F.col("path") == "index.md", line("Old", "a", A)).otherwise(F.col("text")))
    none = spark.createDataFrame([], "page_id string, choice string, pos int")
    merged = spark.createDataFrame([], "page_id string, merged_text string, merged_hash string")
    after, _ = dataclasses.replace(tree, local=linked).pull(records, none, merged, "t1")
    after = published(after)
    assert after.local.where("path = 'index.md'").first().text.split("\n") == [line("A", "a", A), line("B", "b", B)]
    assert after.verify().count() == 0 and {r.state for r in after.status(records)["states"].collect()} == {"clean"}


def test_enumerate(spark):
    _, tree = start(spark)
    links = spark.createDataFrame([(R, A), (A, B), (B, R)], "src string, dst string")
    found, ended = tree.enumerate(links)
    assert found.count() == 3 and ended


def test_sql_names(spark):
    names = sql.register(spark)
    assert len(names) == len(set(names))
    row = spark.sql(r"SELECT tree_slug('Tea & Two: Cups!') AS s, tree_fingerprint('') AS f, tree_sweep_tags('<x>1</x><b>2</b>') AS w, tree_unescape_prose(r'\$ \a') AS u, tree_basename('a/b.md') AS p, tree_slug('') AS e").first()
    assert (row.s, row.w, row.u, row.p, row.e) == ("tea--two-cups", "<b>2</b>", r"$ \a", "b.md", "untitled")
    assert row.f == "sha256:e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
