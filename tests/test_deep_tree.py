"""Trees deeper than the levels that paths once ended at."""

import pytest

from canopy.operators import graph

PAGES = "page_id string, parent_page_id string, title string, created_at long"


def test_deep_pages_have_paths_and_waves(spark):
    rows = [(f"p{i}", f"p{i - 1}" if i else None, f"n{i}", i) for i in range(71)]
    rows += [("x", "y", "X", 1), ("y", "x", "Y", 1), ("z", "unknown", "Z", 1)]  # a cycle, an unknown parent
    paths = graph.tree_paths(spark.createDataFrame(rows, PAGES))
    got = {r.page_id: (r.path, r.depth) for r in paths.collect()}
    assert set(got) == {f"p{i}" for i in range(71)}
    assert got["p70"] == ("/".join(f"n{i}" for i in range(1, 71)) + ".md", 70)
    waves = graph.create_waves(spark.createDataFrame([("p70",), ("p65",)], "page_id string"), paths).collect()
    assert {(r.page_id, r.wave, r.folder_page) for r in waves} == {("p70", 70, False), ("p65", 65, True)}


def test_repeated_ids_on_a_cycle_are_an_error(spark):
    rows = [("a", None, "A", 0), ("a", "a", "A", 1)]
    with pytest.raises(ValueError, match="repeat"):
        graph.tree_paths(spark.createDataFrame(rows, PAGES))
