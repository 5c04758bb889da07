"""Fixed values of the contracts, word by word, apart from the constants in the code."""

from canopy.llm import urls


def test_each_rule_has_the_word_of_the_contract(spark, tmp_path):
    """block com/en/, allow example.com/en/7, allow net/de/, block example.net/de/8, block org/es/."""
    rows = [(1, "s://a.com/en/"), (2, "s://example.com/en/71"), (3, "s://a.net/de/x"), (4, "s://b.example.net/de/8"), (5, "s://org/es/q?x"), (20, "s://a.net/de/x")]
    spark.createDataFrame(rows, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.rule, r.verdict) for r in urls.op6_urls(spark, str(tmp_path)).collect()}
    # the last one is on the list, and its rule comes before that
    assert got == {
        1: ("com/en/", "block"), 2: ("example.com/en/7", "allow"), 3: ("net/de/", "allow"), 4: ("example.net/de/8", "block"), 5: ("org/es/", "block"), 20: ("net/de/", "allow"),
    }
