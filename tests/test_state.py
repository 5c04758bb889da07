from pyspark.sql import functions as F

from canopy import catalog
from canopy.operators import graph, links, merge, state
from canopy.sources import durable, readers
from canopy.streaming import remote
from compare import TABLES, oracle, same

M = "page_id string, path string, title string, parent_page_id string, url string, last_synced_at string, local_hash string, remote_hash string, has_children boolean, local_ignored boolean, push_pending boolean"


def manifest(spark, rows):
    return spark.createDataFrame([(p, path, p.upper(), "up", "", "t0", lh, rh, False, ign, False) for p, path, lh, rh, ign in rows], M)


def test_classification_truth_table(spark):
    m = manifest(spark, [("p1", "1", "a", "b", False), ("p2", "2", "a", "b", False), ("p3", "3", "a", "b", False), ("p4", "4", "a", "b", False), ("p5", "5", "a", "b", False), ("p6", "6", "a", "b", False), ("p7", "7", "a", "b", True), ("p8", "8", "a", "b", False)])
    local = spark.createDataFrame([("1", "a"), ("2", "x"), ("3", "a"), ("4", "x"), ("6", "a"), ("8", "same")], "path string, hash string")
    read = spark.createDataFrame([("p1", "b"), ("p2", "b"), ("p3", "y"), ("p4", "y"), ("p5", "b"), ("p7", "b"), ("p8", "same")], "page_id string, remote_hash string")
    pull = {r.page_id: r.state for r in state.pull_classify(m, local, read).collect()}
    assert pull == {"p1": "clean", "p2": "auto_merge_local", "p3": "auto_merge_remote", "p4": "conflict", "p5": "auto_merge_local", "p8": "clean"}
    status = {r.page_id: r.state for r in state.status_classify(m, local, read).collect()}
    assert status == {"p1": "clean", "p2": "modified_local", "p3": "modified_remote", "p4": "conflict", "p5": "modified_local", "p6": "untracked_remote_hash", "p8": "conflict"}
    assert [r.page_id for r in state.illusory_conflicts(m, local, read).collect()] == ["p8"]


def test_renames_need_one_page_and_one_file(spark):
    m = manifest(spark, [("p1", "a/x.md", "h1", "r", False), ("p2", "b/y.md", "h2", "r", False), ("p3", "c/y.md", "h3", "r", False), ("p4", "d/z.md", "h4", "r", False)])
    local = spark.createDataFrame([("n/x.md", "h9"), ("n/y.md", "h2"), ("d/z.md", "h4")], "path string, hash string")
    assert [tuple(r) for r in state.rename_candidates(m, local).collect()] == [("p1", "a/x.md", "n/x.md")]
    assert [tuple(r) for r in state.rename_candidates(m, local, "hash").collect()] == [("p2", "b/y.md", "n/y.md")]


def test_last_record_wins(spark):
    df = spark.createDataFrame([("p", "a", 0), ("p", "b", 1), ("q", "c", 0)], "page_id string, remote_hash string, pos int")
    assert {(r.page_id, r.remote_hash) for r in state.last_by_key(df).collect()} == {("p", "b"), ("q", "c")}


def test_root_backfill(spark):
    m = manifest(spark, [("p1", "1", "a", "b", False)])
    assert state.root_backfill_needed("p1", m).count() == 0 and state.root_backfill_needed("root", m).count() == 1


def test_pull_then_status_is_clean(spark):
    m = manifest(spark, [("p1", "1", "a", "b", False), ("p2", "2", "a", "b", False)])
    local = spark.createDataFrame([("1", "t1", "a"), ("2", "t2", "x")], "path string, text string, hash string")
    read = spark.createDataFrame([("p1", "y"), ("p2", "y")], "page_id string, remote_hash string")
    bodies = spark.createDataFrame([("p1", "new1", "y", None, None), ("p2", "new2", "y", "m", "mh")], "page_id string, remote_text string, remote_hash string, merged_text string, merged_hash string")
    choices = spark.createDataFrame([("p2", "L", 0), ("p2", "R", 1)], "page_id string, choice string, pos int")
    done = merge.pull_apply(m, local, state.pull_classify(m, local, read), bodies, choices, "t1")
    assert {r.state for r in state.status_classify(done.manifest, done.local, read).collect()} == {"clean"}
    assert state.mismatches(done.manifest, done.local).count() == 0
    kept = merge.pull_apply(m, local, state.pull_classify(m, local, read), bodies, choices.where("choice = 'L'"), "t1")
    row = kept.manifest.where("page_id = 'p2'").first()
    assert (row.local_hash, row.remote_hash, row.push_pending) == ("x", "y", True)
    assert {r.page_id: r.state for r in state.pull_classify(kept.manifest, kept.local, read).collect()} == {"p1": "clean", "p2": "auto_merge_local"}
    assert [(r.page_id, r.kind) for r in state.commit_partition(kept.manifest, kept.local).collect()] == [("p2", "modified")]


def test_kept_local_without_a_file_leaves_no_older_snapshot(spark):
    m = manifest(spark, [("p1", "1", "a", "b", False), ("p2", "2", "a", "b", False), ("p3", "3", "a", "b", False)])
    local = spark.createDataFrame([("2", "t2", "x"), ("moved/1", "t1", "a")], "path string, text string, hash string")
    bodies = spark.createDataFrame([(p, "new", "y", None, None) for p in ("p1", "p2", "p3")], "page_id string, remote_text string, remote_hash string, merged_text string, merged_hash string")
    choices = spark.createDataFrame([("p1", "L", 0), ("p2", "L", 0), ("p3", "S", 0)], "page_id string, choice string, pos int")
    old = spark.createDataFrame([(p, "old") for p in ("p1", "p2", "p3", "p4")], "page_id string, body string")
    done = merge.pull_apply(m, local, state.pull_classify(m, local, bodies), bodies, choices, "t1", old)
    assert sorted((r.page_id, r.body) for r in done.snapshots.collect()) == [("p1", None), ("p2", "t2"), ("p3", "old"), ("p4", "old")]


def test_pull_snapshots_equal_oracle_where_files_are_gone(spark, tmp_path):
    for name in TABLES:
        (tmp_path / f"{name}.parquet").symlink_to(f"/root/testdata/sf0.001/{name}.parquet")
    (tmp_path / "documents.parquet").unlink()
    ids = spark.range(200, 800).withColumnRenamed("id", "doc_id")  # 220, 260, 440, 520, 660 and 780 are kept without a file
    ids.select("doc_id", F.concat(F.lit("words of "), F.col("doc_id").cast("string")).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source")).coalesce(1).write.parquet(str(tmp_path / "documents"))
    (tmp_path / "documents.parquet").symlink_to(next((tmp_path / "documents").glob("part-*.parquet")))
    got = catalog.queries()["pull_snapshots"](spark, str(tmp_path)).toPandas()
    assert got.snapshot_hash.isna().sum() == 6
    same(got, oracle(catalog.oracle_sql()["pull_snapshots"], str(tmp_path)))


def test_missing_on_both_sides_is_not_clean(spark):
    m = manifest(spark, [("p1", "1", "a", "b", False)])
    none = spark.createDataFrame([], "path string, hash string")
    read = spark.createDataFrame([("p1", None)], "page_id string, remote_hash string")
    assert [r.state for r in state.pull_classify(m, none, read).collect()] == ["conflict"]
    assert state.illusory_conflicts(m, none, read).count() == 0


def test_root_page_is_not_trashed(spark):
    m = manifest(spark, [("p1", "1", "a", "b", False)]).unionByName(manifest(spark, [("r", "index.md", "a", "b", False)]).withColumn("parent_page_id", F.lit(None).cast("string")))
    chosen = spark.createDataFrame([("p1", "O"), ("r", "O"), ("x", "M")], "page_id string, choice string")
    assert {(r.page_id, r.action) for r in merge.disposals(m, chosen).collect()} == {("p1", "move_to_workspace"), ("r", "refused")}


def test_closure_handles_cycles_and_caps(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (9, 1)], "src long, dst long")
    roots = spark.createDataFrame([(1,)], "page_id long")
    found, ended = graph.frontier_closure(edges, roots)
    assert sorted((r.page_id, r.depth) for r in found.collect()) == [(1, 0), (2, 1), (3, 2), (4, 3)] and ended
    found, ended = graph.frontier_closure(edges, roots, most=2)
    assert found.count() == 2 and not ended


def test_slugs_of_siblings(spark):
    rows = [("r", None, "Root", 0), ("a", "r", "Same", 2), ("b", "r", "same", 1), ("c", "r", "Index", 1), ("d", "a", "x", 1)]
    df = spark.createDataFrame(rows, "page_id string, parent_page_id string, title string, created_at long")
    assert {r.page_id: r.path for r in graph.tree_paths(df).collect()} == {"r": "index.md", "b": "same.md", "a": "same-2/index.md", "c": "index-2.md", "d": "same-2/x.md"}


def test_regenerate(spark):
    ids = [f"{i}{i}{i}{i}{i}{i}{i}{i}-bbbb-cccc-dddd-eeeeeeeeeeee" for i in range(3)]
    line = lambda n, t: f'[{t}](./{n}.md) <!-- tree:child page_id="{ids[n]}" -->'
    body = "\n".join(["top", line(0, "old"), line(1, "orphan"), "[p](./p.md) <!-- tree:child -->", "end"])
    bodies = spark.createDataFrame([("f", "index.md", body), ("g", "g.md", "only text\n\n")], "page_id string, path string, body string")
    expected = spark.createDataFrame([("f", ids[0], 0), ("f", ids[2], 1), ("f", ids[2], 2), ("g", ids[0], 0)], "page_id string, child string, seq int")
    pages = spark.createDataFrame([(ids[0], "0.md", "New"), (ids[2], "2.md", "Two")], "page_id string, path string, title string")
    got = {r.page_id: r for r in links.regenerate(bodies, expected, pages).collect()}
    assert got["f"].body.split("\n") == ["top", line(0, "New"), "[p](./p.md) <!-- tree:child -->", line(2, "Two"), "end"]
    assert (got["f"].added, got["f"].dropped) == (1, 1)
    assert got["g"].body.split("\n") == ["only text", line(0, "New"), "", ""]


def test_readers_and_published_tables(spark, tmp_path):
    (tmp_path / "tree" / ".tree").mkdir(parents=True)
    (tmp_path / "tree" / "a.md").write_text("x \\$\n\n\ny\n")
    (tmp_path / "tree" / "b.MD").write_bytes(b"\xff")
    (tmp_path / "tree" / "c.txt").write_text("no")
    (tmp_path / "tree" / ".tree" / "s.md").write_text("state")
    files = readers.markdown_files(spark, str(tmp_path / "tree"))
    hashes = {r.path: r.hash for r in readers.local_hashes(files).collect()}
    import hashlib

    assert hashes == {"a.md": "sha256:" + hashlib.sha256(b"x $\ny\n").hexdigest(), "b.MD": "ERROR:malformed UTF-8"}
    (tmp_path / "m.json").write_text('{"schema_version":1,"pages":{"AB":{"path":"p.md","has_children":true}},"trash_log":[]}')
    row = readers.manifest(spark, str(tmp_path / "m.json")).first()
    assert (row.page_id, row.path, row.has_children, row.local_ignored) == ("ab", "p.md", True, False)
    (tmp_path / "r.json").write_text('{"records":[{"page_id":"p","remote_hash":"1"},{"page_id":"p","remote_hash":"2"}]}')
    assert [r.remote_hash for r in readers.records(spark, str(tmp_path / "r.json")).collect()] == ["2"]
    (tmp_path / "r2.json").write_text('[{"page_id":"q","remote_hash":"3"}]')
    assert [r.page_id for r in readers.records(spark, str(tmp_path / "r2.json")).collect()] == ["q"]
    (tmp_path / "ig").write_text("*.tmp\n#c\n\n!a\n")
    assert readers.ignore_list(spark, str(tmp_path / "ig")) == ["*.tmp", "!a"] and readers.ignore_list(spark, str(tmp_path / "none")) == []
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "12345678-1234-1234-1234-123456789ABC.fetch.txt").write_text("t")
    (tmp_path / "f" / "other.fetch.txt").write_text("t")
    assert [tuple(r) for r in readers.fetched(spark, str(tmp_path / "f")).collect()] == [("12345678-1234-1234-1234-123456789abc", "t")]
    lists = spark.createDataFrame([("a\x00b\nc\x00",), ("a\n\nb",)], "t string").select(readers.batch_paths(F.col("t")).alias("p"))
    assert [r.p for r in lists.collect()] == [["a", "b\nc"], ["a", "b"]]
    table = str(tmp_path / "t")
    durable.publish(spark.range(3), table)
    durable.publish(spark.range(5), table)
    assert durable.latest(spark, table).count() == 5


def test_stream_equals_batch(spark, tmp_path):
    m = manifest(spark, [("p1", "1", "a", "b", False), ("p2", "2", "a", "b", False)]).withColumn("batch", F.lit(-1).cast("long"))
    local = spark.createDataFrame([("1", "t1", "a"), ("2", "t2", "changed")], "path string, text string, hash string")
    mt, lt, src = (str(tmp_path / x) for x in ("m", "l", "in"))
    durable.publish(m, mt)
    durable.publish(local, lt)
    rows = spark.createDataFrame([("p1", "<content>\nold\n</content>", 0), ("p1", "<content>\nnew\n</content>", 1), ("p2", "<content>\nz\n</content>", 2)], "page_id string, text string, pos long")
    rows.write.parquet(src)
    stream = spark.readStream.schema(rows.schema).parquet(src)
    remote.follow(stream, mt, lt, str(tmp_path / "ck"), "t1").awaitTermination()
    after = {r.path: r.text for r in durable.latest(spark, lt).collect()}
    assert after == {"1": "new\n", "2": "t2"}
    assert not remote.apply_batch(rows, 0, mt, lt, "t2")
