"""What keeps memory and time in proportion: rows that a worker holds at once, and texts that are canonicalised once."""

import re

import pyarrow as pa
from pyspark.sql import functions as F

from canopy.functions import canon, kernels
from canopy.operators import links
from canopy.plans import sync_queries

SIZE = "spark.sql.execution.arrow.maxRecordsPerBatch"


def test_workers_get_few_rows_at_once(spark):
    for use in (lambda df: canon.canonical(df, "body", "out"), lambda df: links.rich_block_catalogue(df, F.col("body"))):
        spark.conf.set(SIZE, "10000")
        df = spark.createDataFrame([("p", "x")], "page_id string, body string")
        assert use(df).count() in (0, 1) and int(spark.conf.get(SIZE)) <= kernels.PIECE
    spark.conf.set(SIZE, "7")  # a smaller bound of the user's stays
    kernels.small_batches(spark)
    assert spark.conf.get(SIZE) == "7"
    spark.conf.unset(SIZE)


def test_few_rows_of_a_batch_are_objects_at_once():
    class Column:
        """An Arrow column that notes how many rows become Python objects at once."""

        def __init__(self, column, seen):
            self.column, self.seen = column, seen

        def __len__(self):
            return len(self.column)

        def slice(self, *a):
            return Column(self.column.slice(*a), self.seen)

        def to_pylist(self):
            self.seen.append(len(self.column))
            return self.column.to_pylist()

    for n in (0, 1, kernels.PIECE, 3 * kernels.PIECE + 1):
        texts, seen = [None if i % 5 == 4 else f"<x-y/>{i}" for i in range(n)], []
        got = kernels._strings(Column(pa.array(texts, pa.string()), seen), lambda x: kernels.sweep(x)[0])
        assert got.type == pa.string() and got.to_pylist() == [x and x.removeprefix("<x-y/>") for x in texts]
        assert sum(seen) == n and max(seen, default=0) <= kernels.PIECE


def test_pull_takes_no_text_again(spark):
    """Its plan had 22 scans of documents and 32 steps of Python; now its inputs are tables."""
    plan = sync_queries.commit_after_pull(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan
    read = re.findall(r"documents\.parquet.*?ReadSchema: struct<([^>]*)>", plan)
    assert read and not any("text" in columns for columns in read)
