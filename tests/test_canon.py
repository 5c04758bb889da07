"""Golden cases of the canonical form, each through the mixed path of ``canonical``."""

import pytest
from pyspark.sql import functions as F

from canopy.functions import canon, kernels

CHILD = '[Kettle](./kitchen/kettle.md) <!-- tree:child page_id="0f0f0f0f-1e1e-2d2d-3c3c-4b4b4b4b4b4b" -->'
PAGE = '<page url="https://wiki.example/kettle" icon="K">Kettle</page>'
CASES = [
    # what only remote texts lose
    ("remote", None, f"<empty-block/>\nTea\n{PAGE}\n<empty-block />\n", "\nTea\n"),
    ("remote", None, "Tea\n<gadget-box size='9'>lid\nspout</gadget-box>\nCups\n", "Tea\nCups\n"),
    ("remote", None, "Tea<spoon-rest n=1/>\nCups <saucer>\n", "Tea\nCups\n"),
    ("remote", None, "Tea\n<toggle>\n# Milk\n</toggle>\nCups\n", "Tea\nCups\n"),
    ("remote", None, "Tea\n![pot](pot.png) {width=40}\nCups\n", "Tea\nCups\n"),
    ("remote", None, "Tea in a ![pot](pot.png) now\n", "Tea in a ![pot](pot.png) now\n"),
    ("remote", None, "<p><leaf>green</p></leaf><twig/>", "<p>green</p></leaf>\n"),
    ("remote", None, "<div><x>t</x></div><y/>", "<div>t</x></div>\n"),
    ("remote", None, "\u00e9 <column_list><column>a</column></column_list> <pdf src='x'>z\n", "\u00e9  z\n"),
    ("remote", None, "<a-b>one</a>two</a-b>three", "three\n"),
    ("remote", None, "<a-b>one</a>two", "one</a>two\n"),
    ("remote", None, "<q-leaf-x>one</q-leaf>two", "two\n"),
    # what local texts keep, and what both lose
    ("local", None, "Tea\n![pot](pot.png)\nCups\n", "Tea\n![pot](pot.png)\nCups\n"),
    ("local", None, f"<toggle>milk</toggle>\n{CHILD}\nTea\n", "<toggle>milk</toggle>\nTea\n"),
    ("local", None, f"Tea\n{PAGE}\nCups\n", "Tea\nCups\n"),
    ("local", None, "[Cup](cup.md) <!-- tree:child -->\nTea [Cup](cup.md)\n", "Tea [Cup](cup.md)\n"),
    # characters, line ends and blanks
    ("local", None, "Tea\rCups\r\nMilk", "Tea\nCups\nMilk\n"),
    ("local", None, "cafe\u0301 o\u0308\n", "caf\u00e9 \u00f6\n"),
    ("local", None, "Tea\u2003\nCups\x1c\n\n", "Tea\nCups\n"),
    ("local", None, "Tea\n\n\nCups\n\nMilk\n", "Tea\nCups\nMilk\n"),
    ("local", None, "Tea\n\t\nCups", "Tea\n\nCups\n"),
    ("local", None, "", ""),
    ("local", None, "\n\n", ""),
    ("local", None, None, None),
    # titles
    ("local", "Tea Time", "# Tea Time\n\nAt five\n", "At five\n"),
    ("remote", "Tea Time", "\n# Tea Time  \nAt five\n", "\nAt five\n"),
    ("local", None, "# Tea Time\n\nAt five\n", "# Tea Time\nAt five\n"),
    ("local", "Tea Time", "# Supper\n\nAt six\n# Tea Time\n", "# Supper\nAt six\n# Tea Time\n"),
    ("local", "Tea", "\n \n   # Tea \t\nx", "\n\nx\n"),
    ("local", "Tea", "# Tea", ""),
    # tables
    ("local", None, "<table><tbody><tr><th>cup</th><th>ml</th></tr><tr><td>small</td><td>90 &lt; 99</td></tr></tbody></table>", "| cup | ml |\n| --- | --- |\n| small | 90 < 99 |\n"),
    ("local", None, "<table><tr><td>one<br>two|three</td></tr></table>", "| onetwo|three |\n| --- |\n"),
    ("local", None, "<table><tr><td>a</td></tr><tr><td>b</td><td>c</td></tr></table>\n", "<table><tr><td>a</td></tr><tr><td>b</td><td>c</td></tr></table>\n"),
    ("local", None, "<table><tr><td colspan=2>a</td></tr></table>\n", "<table><tr><td colspan=2>a</td></tr></table>\n"),
    # escapes, links and code
    ("local", None, "Cups \\#3 cost \\$4 \\(each\\) \\q\n", "Cups #3 cost $4 (each) \\q\n"),
    ("local", None, "```\nCups \\#3\n```\n", "```\nCups \\#3\n```\n"),
    ("local", None, "[mailto:a@b.example](mailto:a@b.example) [tea.example](https://tea.example)\n", "mailto:a@b.example tea.example\n"),
    ("local", None, "[tea](https://tea.example)\n", "[tea](https://tea.example)\n"),
    ("local", None, "```c++\nbrew();\n\n\npour();\n```  \nTea\n\nCups\n", "```\nbrew();\n\n\npour();\n```\nTea\nCups\n"),
    ("local", None, "```py title=tea\nbrew\n\n\npour\n```\n", "```py title=tea\nbrew\npour\n```\n"),
]


@pytest.mark.parametrize("mode", ["local", "remote"])
def test_goldens(spark, mode):
    cases = [(i, t, x, w) for i, (m, t, x, w) in enumerate(CASES) if m == mode]
    df = spark.createDataFrame(cases, "i int, title string, text string, want string")
    done = canon.canonical(df, "text", "got", mode, F.coalesce("title", F.lit("")))
    bad = [(r.text, r.want, r.got) for r in done.collect() if r.want != r.got]
    assert not bad
    one = df.select("text", "want", canon.normalize(F.col("text"), mode, F.coalesce("title", F.lit(""))).alias("got"))
    assert [(r.text, r.want, r.got) for r in one.limit(4).collect() if r.want != r.got] == []


def test_a_page_hashes_alike_as_file_and_as_fetched(spark):
    file = "# Tea\n\nBrew at #5, see https://tea.example/a\n\n|cup|ml|\n|:-|-|\n|small|90|\n\n```sh\nboil\n```\n"
    fetched = "Brew at \\#5, see [https://tea.example/a](https://tea.example/a)\n|cup|ml|\n|:---|---|\n|small|90|\n<callout>hot</callout>\n```\nboil\n```"
    df = spark.createDataFrame([(file, fetched)], "a string, b string")
    one = canon.canonical(df, "a", "x", "local", F.lit("Tea"))
    row = canon.canonical(one, "b", "y", "remote", F.lit("Tea")).first()
    assert row.x == row.y


def test_a_text_is_read_once(spark, tmp_path):
    spark.createDataFrame([("Tea <b>x</b>",), ("Cups",)], "text string").write.parquet(str(tmp_path / "t"))
    plan = canon.canonical(spark.read.parquet(str(tmp_path / "t")), "text", "out", "remote", F.lit("Tea"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_unknown_names_are_reported_in_order():
    assert kernels.sweep("<Aa>1</Aa><b>2</b><c-d/><aa>") == ("<b>2</b>", ["aa", "c-d"])


def test_mode_is_checked(spark):
    with pytest.raises(ValueError):
        canon.normalize(F.lit("x"), "other")


def test_malformed_bytes_raise(spark):
    df = spark.createDataFrame([(bytearray(b"\xff"),)], "b binary")
    with pytest.raises(Exception, match="MALFORMED"):
        df.select(canon.decode(F.col("b"))).collect()
