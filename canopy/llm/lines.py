"""Line dedup: repeated runs of lines, found by a suffix array over line ids; later copies are deleted.

A text is the sequence of its lines that are not blank. Lines become ids (places in the order of their 128-bit hashes)
and only lines that occur twice or more can be in a repeated run, so other lines part the sequences. Prefix doubling
ranks all suffixes by their first h = 1, 2, 4, ... lines: a suffix's pair of ranks at its own place and h lines on gets
a new rank in the order of pairs. The order comes from range partitions, never from one task. Suffixes of equal rank are
an interval of the suffix array whose common prefix has h lines or more; an interval of one suffix holds no repeat and
is dropped.

A repeated run counts from ``least_words`` words. Every maximal run that has an earlier copy (in the order of id, row
and line, null ids last) is deleted whole. Such a run R is the union of the windows of just enough words in it: take a
line x of R. If R has enough words up to x, the shortest window that ends at x lies in R and holds x. If not, the
shortest window from R's first line on goes beyond x and lies in R, as R has enough words. On the other hand a window
with an earlier copy is part of a maximal run. So it suffices to find windows that have an earlier copy: those of just
enough words from each line on, and those up to each line. They have at most a line for each word, which is where
doubling ends. A window of l lines is named by two ranks that overlap (h lines at its first place, h lines ending at its
last, h the power of two below l): windows with the same name are an interval of common prefixes of l lines; its first
window stays and the lines of all others go. Neighbouring lines that went are the maximal runs.

Lines and windows that make up a thousandth of all rows or more are joined where they lie (``join_counted``), so that
one common line is no task of its own. Tables between are deleted as soon as they are read for the last time.

Repeats within a text count as well. Blank lines stay. Null texts stay null; a text can become empty and stays a row.
Rows with equal ids (or null, which comes last) are in the order of their reading; ids are of any type with an order.
Lines of any length are hashed whole; their copies are met by hash only. Lines end with U+000A alone: a carriage return
before it is part of the line, so ``x`` and the same line with one are different. Tables of any kind of further columns
are carried by position. Empty table: empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from canopy.llm.shared import drop_tables, global_rank, join_counted, materialize, release

LEAST_WORDS = 10


def _is_text(line):
    return F.trim(line, F.lit(" \t\r")) != ""


def _lines(text):
    """Lines that are not blank, with their places among all lines."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: _is_text(s["x"]))


def _ranked(pairs: DataFrame, by: list[str], kept: list[str], label: str) -> DataFrame:
    """``kept`` and r: the rank of each row of ``pairs`` in the order of ``by``; values that occur once are left out."""
    several = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    ranks = global_rank(several, by, "r", label)
    named = ranks.select(*[F.col(b).alias(f"of_{b}") for b in by], "n", "r")
    out = materialize(join_counted(pairs, named, {b: f"of_{b}" for b in by}, "n", pairs.count()).select(*kept, "r"), "suffixes")
    drop_tables(ranks, pairs)
    return out


def _doubled(ranks: DataFrame, h: int) -> DataFrame:
    """``ranks(doc, k, r)`` by 2h lines from those by h lines."""
    on = ranks.select(F.col("doc").alias("d2"), (F.col("k") - h).alias("k2"), F.col("r").alias("r2"))
    pairs = ranks.withColumnRenamed("r", "r1").join(on, (F.col("doc") == F.col("d2")) & (F.col("k") == F.col("k2"))).select("doc", "k", "r1", "r2")
    return _ranked(materialize(pairs, "pairs"), ["r1", "r2"], ["doc", "k"], "ranks")


def _windows(run: DataFrame, least_words: int, back: bool) -> DataFrame:
    """``doc, id, k, l``: the shortest windows of enough words from each line on; ``back``: those up to each line."""
    order = F.col("k").desc() if back else F.col("k")
    near = Window.partitionBy("doc", "run").orderBy(order).rowsBetween(0, least_words - 1)
    sums = F.aggregate("ws", F.struct(F.lit(0).alias("n"), F.lit(0).alias("sum")), lambda a, w: F.when(a["sum"] >= least_words, a).otherwise(F.struct((a["n"] + 1).alias("n"), (a["sum"] + w).alias("sum"))))
    out = run.withColumn("ws", F.collect_list("w").over(near)).select("doc", "id", "k", "w", sums.alias("a")).where(F.col("a.sum") >= least_words)
    if not back:
        return out.select("doc", "id", "k", F.col("a.n").alias("l"))
    full = F.col("a.sum") - F.col("w") >= least_words  # enough without the last line: no window from its first line on
    return out.where(full).select("doc", "id", (F.col("k") - F.col("a.n") + 1).alias("k"), F.col("a.n").alias("l"))


def repeats(docs: DataFrame, least_words: int) -> DataFrame:
    """``docs(doc, id, text)`` with unique doc: doc and ks, the places (among lines that are not blank) of lines to delete."""
    words = F.length("x") - F.length(F.replace(F.col("x"), F.lit(" "), F.lit(""))) + 1
    lines = docs.select("doc", "id", F.posexplode(_lines(F.col("text"))).alias("k", "s")).select("doc", "id", "k", F.col("s.x").alias("x"))
    lines = lines.select("doc", "id", "k", F.xxhash64("x").alias("h1"), F.xxhash64(F.lit(7), "x").alias("h2"), F.least(words, F.lit(least_words)).cast("int").alias("w"))
    at = _ranked(materialize(lines, "lines"), ["h1", "h2"], ["doc", "id", "k", "w"], "line-ids")
    # windows lie inside the run of neighbouring repeated lines
    run = at.withColumn("run", F.col("k") - F.row_number().over(Window.partitionBy("doc").orderBy("k")))
    windows = materialize(_windows(run, least_words, False).unionByName(_windows(run, least_words, True)), "windows")
    longest = windows.agg(F.max("l")).first()[0] or 0
    ranks, h, parts = at.select("doc", "k", "r"), 1, []
    ranks._canopy_path = at._canopy_path
    while h <= longest:
        here = windows.where((F.col("l") >= h) & (F.col("l") < 2 * h))
        head = ranks.select(F.col("doc").alias("d1"), F.col("k").alias("k1"), F.col("r").alias("r1"))
        tail = ranks.select(F.col("doc").alias("d2"), F.col("k").alias("k2"), F.col("r").alias("r2"))
        named = here.join(head, (F.col("doc") == F.col("d1")) & (F.col("k") == F.col("k1")))
        if h > 1:  # at one line both ranks are the same
            named = named.join(tail, (F.col("doc") == F.col("d2")) & (F.col("k") + F.col("l") - h == F.col("k2")))
        else:
            named = named.withColumn("r2", F.col("r1"))
        parts.append(materialize(named.select("doc", "id", "k", "l", "r1", "r2"), "named"))
        if 2 * h > longest:
            break
        new = _doubled(ranks, h)
        drop_tables(ranks)
        ranks, h = new, 2 * h
    drop_tables(windows, ranks)
    release(docs.sparkSession)
    if not parts:
        return materialize(docs.sparkSession.createDataFrame([], "doc long, ks array<int>"), "gone")
    found = reduce(DataFrame.unionByName, parts)
    place = F.struct(F.col("id").isNull().alias("none"), "id", "doc", "k")
    first = found.groupBy("l", "r1", "r2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = first.select(F.col("l").alias("fl"), F.col("r1").alias("f1"), F.col("r2").alias("f2"), "first", "n")
    later = join_counted(found, first, {"l": "fl", "r1": "f1", "r2": "f2"}, "n", found.count()).where(place != F.col("first"))
    gone = later.select("doc", F.explode(F.sequence("k", F.col("k") + F.col("l") - 1)).alias("k"))
    gone = materialize(gone.groupBy("doc").agg(F.collect_set("k").alias("ks")), "gone")
    drop_tables(*parts)
    release(docs.sparkSession)
    return gone


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` by position (c0, c1, ...), its text without the deleted lines, plus n_lines, n_removed and removed.

    removed: the places of deleted lines among all lines of the text, in order.
    """
    names = docs.columns
    flat = docs.toDF(*[f"c{i}" for i in range(len(names))])
    text = f"c{names.index(text_col)}"
    stored = materialize(flat.withColumn("doc", F.monotonically_increasing_id()), "documents")
    gone = repeats(stored.select("doc", F.col(f"c{names.index(id_col)}").alias("id"), F.col(text).cast("string").alias("text")), least_words)
    gone = gone.select(F.col("doc").alias("gd"), "ks")
    joined = stored.join(gone.hint("merge"), F.col("doc") == F.col("gd"), "left")
    # texts that lose nothing are passed on unparsed
    hit = F.col("ks").isNotNull()
    joined = joined.withColumn("__all", F.when(hit, F.split(F.col(text), "\n"))).withColumn("__places", F.when(hit, F.transform(_lines(F.col(text)), lambda s: s["i"])))
    removed = F.when(hit, F.array_sort(F.transform("ks", lambda k: F.get("__places", k)))).otherwise(F.array().cast("array<int>"))
    joined = joined.withColumn("removed", removed)
    kept = F.array_except(F.sequence(F.lit(0), F.size("__all") - 1), "removed")
    left = F.when(hit, F.array_join(F.transform(kept, lambda i: F.get("__all", i)), "\n")).otherwise(F.col(text))
    breaks = F.length(text) - F.length(F.replace(F.col(text), F.lit("\n"), F.lit("")))
    n_lines = F.coalesce(breaks + 1, F.lit(0)).cast("long")
    return joined.withColumns({"n_lines": n_lines, "n_removed": F.size("removed").cast("long"), text: left}).select(*flat.columns, "n_lines", "n_removed", "removed")


def op2_lines(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = dedup(docs)
    return out.select(F.col("c0").alias("doc_id"), "n_lines", "n_removed", F.array_join("removed", ",").alias("removed"), F.sha2(F.coalesce("c1", F.lit("")), 256).alias("kept_sha256"))


#: Every line of a text against every earlier equal line: neighbours of the same two texts at the same distance are runs.
OP2_SQL = f"""
WITH a AS (
  SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), u AS (
  SELECT doc_id, unnest(ls) AS x, unnest(range(len(ls))) AS i FROM a
), b AS (
  SELECT doc_id, x, i, length(x) - length(replace(x, ' ', '')) + 1 AS w,
    row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k
  FROM u WHERE trim(translate(x, chr(9) || chr(13), '  ')) <> ''
), pair AS (
  SELECT l.doc_id, l.i, l.k, l.w, e.doc_id AS of, l.k - e.k AS shift,
    l.k - row_number() OVER (PARTITION BY l.doc_id, e.doc_id, l.k - e.k ORDER BY l.k) AS run
  FROM b l JOIN b e ON l.x = e.x AND (e.doc_id < l.doc_id OR (e.doc_id = l.doc_id AND e.k < l.k))
), gone AS (
  SELECT DISTINCT doc_id, i FROM (SELECT doc_id, i, sum(w) OVER (PARTITION BY doc_id, of, shift, run) AS words FROM pair) WHERE words >= {LEAST_WORDS}
), r AS (
  SELECT doc_id, count(*) AS n, string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) AS s FROM gone GROUP BY doc_id
), t AS (
  SELECT u.doc_id, string_agg(u.x, chr(10) ORDER BY u.i) AS kept
  FROM u LEFT JOIN gone ON u.doc_id = gone.doc_id AND u.i = gone.i WHERE gone.i IS NULL GROUP BY u.doc_id
)
SELECT a.doc_id, CAST(CASE WHEN a.text IS NULL THEN 0 ELSE len(a.ls) END AS BIGINT) AS n_lines,
  CAST(coalesce(r.n, 0) AS BIGINT) AS n_removed, coalesce(r.s, '') AS removed, sha256(coalesce(t.kept, '')) AS kept_sha256
FROM a LEFT JOIN r ON a.doc_id = r.doc_id LEFT JOIN t ON a.doc_id = t.doc_id
"""
