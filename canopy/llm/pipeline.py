"""A corpus pipeline of five stages over ``documents``.

Language ID drops what it rejects; line dedup deletes later copies of repeated runs of lines; near-dedup keeps one
document of each class (the least by doc_id); mixing repeats or drops documents until every source has its share; BPE
encodes what is left and gives token ids, decoded text and the digests of both. Each stage works on all that the one
before it kept. Each but the last returns the columns of its input; n_chars, where there is one, follows the text. An
empty table passes through all stages.

A stage's result may read tables in the shared folder. These are deleted when the next stage of the session begins,
unless its ``docs`` reads them: write a result before you begin a stage that does not build on it.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.llm import bpe, langid, lines, mixing, near
from canopy.llm.shared import drop_unread, materialize, release, written

WEIGHTS = [1, 2, 3]
#: Of the encoder's cache; smaller than alone, since executors have other stages' memory still.
CACHE_BYTES = 24 << 20

_LEFT: set[str] = set()


def _stage(function):
    """The function, with what earlier stages left in the shared folder deleted first."""

    @wraps(function)
    def run(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
        mine = _LEFT & written(spark)
        _LEFT.difference_update(mine)
        _LEFT.update(drop_unread(docs, mine))
        release(spark)
        before = written(spark)
        out = function(spark, docs, sf_dir)
        _LEFT.update(written(spark) - before)
        return out

    return run


@_stage
def language_id(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = langid.identify_documents(docs).where("lang_ok").drop("lang_id", "lang_prob", "lang_ok")
    return out.toDF(*docs.columns)


@_stage
def line_dedup(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    names = docs.columns
    out = lines.dedup(docs).drop("n_lines", "n_removed", "removed")
    if "n_chars" in names:
        chars = f"c{names.index('n_chars')}"
        out = out.withColumn(chars, F.length(f"c{names.index('text')}").cast(docs.schema[names.index("n_chars")].dataType))
    return out.toDF(*names)


@_stage
def near_dedup(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near.keep_one(docs)


@_stage
def mix_sources(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    names = docs.columns
    mixed = mixing.mix(docs, WEIGHTS, keep=names).where("copies > 0")
    repeated = mixed.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return repeated.select(*[F.col(f"k{i}") for i in range(len(names))]).toDF(*names)


@_stage
def encode(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"), cache_bytes=CACHE_BYTES)


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("mixing", mix_sources),
    ("BPE", encode),
]

#: Similarity classes and the seeded sample can't be said in SQL.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        _LEFT.add(docs._canopy_path)
    return STAGES[-1][1](spark, docs, sf_dir)
