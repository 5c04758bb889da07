"""Empty and null documents: queries equal their SQL, which stores an empty page as one newline."""

import pytest
from compare import oracle, same

from canopy import catalog
from canopy.functions import canon

QUERIES = """backfill_applied batch_hash_duplicates canon_blank_parity canon_crlf_parity canon_escape_parity canon_h1_parity canon_hash_identity
    canon_link_line_parity canon_nfc_parity canon_rich_tag_parity canon_trailing_blank_parity commit_after_pull commit_apply commit_errors commit_partition
    compact_read_records hash_lines hashes_of_bytes init_seed local_vs_remote_modes process_fetch pull_apply pull_snapshots status_scan""".split()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("empty"))
    # ids of every remainder that the queries tell apart; all else but these is the smoke table
    some = "CASE WHEN doc_id IN (2, 3, 6, 8, 9, 16, 25, 29, 31, 40, 58, 62) THEN '' WHEN doc_id NOT IN (12, 37, 74) THEN text END AS text"
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs.selectExpr(*[some if c == "text" else c for c in docs.columns]).write.parquet(f"{out}/documents.parquet")
    return out


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_oracle_where_documents_are_empty(spark, folder, name):
    sql = f"WITH RECURSIVE documents AS (SELECT * FROM '{folder}/documents.parquet/*.parquet')," + catalog.oracle_sql()[name].strip().removeprefix("WITH RECURSIVE")
    same(catalog.queries()[name](spark, folder).toPandas(), oracle(sql, "/root/testdata/sf0.001"))


def test_canonical_form_of_an_empty_text_stays_empty(spark):
    got = spark.range(1).select(canon.normalize(canon.F.lit(""), "local").alias("x")).first().x
    assert got == ""
