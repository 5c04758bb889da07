"""Readers of trees, manifests, ignore lists, records and fetched envelopes, and writers of their outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.functions import canon
from canopy.functions import patterns as P
from canopy.operators import ignore
from canopy.sources import schemas


def _below(root: str, path):
    """Path relative to the root folder."""
    return F.regexp_replace(path, "^.*?" + _quoted(root.split(":", 1)[-1].strip("/")) + "/", "")


def _quoted(text: str) -> str:
    return "\\Q" + text + "\\E"


def markdown_files(spark: SparkSession, root: str, state_dir: str = ".tree") -> DataFrame:
    """path (relative), content of all markdown files below ``root``, the state folder left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{md,MD,mD,Md}").load(root)
    rows = files.select(_below(root, F.col("path")).alias("path"), "content")
    return rows.where(~F.startswith("path", F.lit(state_dir + "/")))


def local_hashes(files: DataFrame, titles: DataFrame | None = None, dialect: P.Dialect = P.DEFAULT) -> DataFrame:
    """path, hash of the canonical form; malformed UTF-8 gives the value ERROR:..., not a failure."""
    good = F.is_valid_utf8(F.col("content").cast("string"))
    rows = files.select("path", F.when(good, F.col("content").cast("string")).alias("text"))
    rows = rows if titles is None else rows.join(titles.select("path", F.nullif("title", F.lit("")).alias("title")), "path", "left")
    done = canon.canonical(rows, "text", "canonical", "local", None if titles is None else F.coalesce("title", F.lit("")), dialect)
    return done.select("path", F.coalesce(canon.fingerprint(F.col("canonical")), F.lit("ERROR:malformed UTF-8")).alias("hash"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """A JSON manifest as one row a page; ids in lower case."""
    raw = spark.read.option("wholetext", "true").text(path).select(F.from_json("value", schemas.MANIFEST, {"mode": "FAILFAST"}).alias("m"))
    return pages_of(raw.select("m.*"))


def pages_of(manifests: DataFrame) -> DataFrame:
    rows = manifests.select(F.explode("pages").alias("page_id", "p"))
    flat = rows.select(F.lower("page_id").alias("page_id"), "p.*")
    return flat.withColumn("local_ignored", F.coalesce("local_ignored", F.lit(False)))


def trash_of(manifests: DataFrame) -> DataFrame:
    return manifests.select(F.explode("trash_log").alias("t")).select("t.*")


def ignore_list(spark: SparkSession, path: str) -> list[str]:
    """The user's ignore file; a missing one is empty."""
    try:
        lines = [r[0] for r in spark.read.option("wholetext", "true").text(path).collect()]
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            return []
        raise
    return ignore.patterns_of("\n".join(lines).split("\n"))


def records(spark: SparkSession, path: str) -> DataFrame:
    """Read records from files that hold a list of them or an object with such a list; of equal ids the last stays."""
    texts = spark.read.option("wholetext", "true").text(path)
    return records_of(texts.select("value"))


def records_of(texts: DataFrame) -> DataFrame:
    listed = f"ARRAY<STRUCT<{', '.join(_typed(schemas.READ_RECORD))}>>"
    bare = F.from_json("value", listed)
    wrapped = F.from_json("value", f"STRUCT<records: {listed}>")["records"]
    rows = texts.select(F.posexplode(F.when(F.trim("value").startswith("["), bare).otherwise(wrapped)).alias("pos", "r")).select("pos", "r.*")
    fields = [c for c in rows.columns if c not in {"pos", "page_id"}]
    return rows.groupBy("page_id").agg(F.max_by(F.struct(*fields), "pos").alias("r")).select("page_id", "r.*")


def _typed(ddl: str) -> list[str]:
    from pyspark.sql.types import StructType

    return [f"{f.name}: {f.dataType.simpleString()}" for f in StructType.fromDDL(ddl)]


def fetched(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, text of the files ``<id>.fetch.txt`` of a folder; other names are skipped."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.fetch.txt").load(folder)
    named = files.select(F.regexp_extract("path", "(?i)/(" + P.ID + r")\.fetch\.txt$", 1).alias("page_id"), F.col("content").cast("string").alias("text"))
    return named.where("page_id <> ''").select(F.lower("page_id").alias("page_id"), "text")


def batch_paths(text):
    """Column of a path list parted by NUL if there is any, else by newline; blank entries dropped."""
    parts = F.when(F.contains(text, F.lit("\x00")), F.split(text, "\x00")).otherwise(F.split(text, "\n"))
    return F.filter(parts, lambda p: ~canon.is_blank(p))


def hash_lines(hashes: DataFrame) -> DataFrame:
    """path, a tab and the hash, as lines."""
    return hashes.select(F.concat_ws("\t", "path", "hash").alias("value"))


def write_bodies(bodies: DataFrame, folder: str) -> None:
    """Bodies as a table keyed by page, ready to be read back (page_id, body)."""
    bodies.select("page_id", "body").write.mode("overwrite").parquet(folder)


def json_lines(rows: DataFrame) -> DataFrame:
    """One JSON object a row, keys in order."""
    return rows.select(F.to_json(F.struct(*[F.col(c) for c in sorted(rows.columns)])).alias("value"))


def manifest_json(pages: DataFrame, trash: DataFrame, config: dict) -> DataFrame:
    """A manifest as one JSON text. A file format for one tree; tables keep the rows."""
    fields = [c for c in pages.columns if c != "page_id"]
    body = pages.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("page_id", F.struct(*fields))))).alias("pages"))
    log = trash.agg(F.sort_array(F.collect_list(F.struct("trashed_at", *[c for c in trash.columns if c != "trashed_at"]))).alias("trash_log"))
    parent = F.struct(*[F.lit(v).alias(k) for k, v in sorted(config["parent"].items())]).alias("parent")
    one = body.crossJoin(log)  # one row each
    return one.select(F.to_json(F.struct("pages", parent, F.lit(config["plugin_version"]).alias("plugin_version"), F.lit(config["schema_version"]).alias("schema_version"), "trash_log")).alias("value"))
