import pytest
from pyspark.sql import functions as F

from canopy.functions import extract, kernels
from canopy.operators import graph, ignore

ENVELOPE = 'What I found:\n<page url="https://wiki.example/tea">\n<properties>{"owner":{"title":"no"},"title":"Tea \\u0026 Cups"}</properties>\n<content>\nBoil.\n\nPour.\nWait five minutes.\n</content>\n</page>\n'
A = "1234abcd-5678-ef90-1234-abcd5678ef90"
HEX = A.replace("-", "")


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    "text,want",
    [
        (ENVELOPE, "Boil.\n\nPour.\nWait five minutes."),
        ("Boil, then\npour\n", "Boil, then\npour\n"),
        ('<page url="tea"><content lang="en">\n</content></page>\n', ""),
        ("<CONTENT>Boil</content> <content>Pour</content>", "Boil"),
        ('{"title":"t","text":"<content>\\na\\\\nb\\n</content>"}', "a\\nb"),
        ('{"text": 5} <content>x</content>', "x"),
        ("{not json \"text\"} <content>y</content>", "y"),
        (ENVELOPE.replace("\n", "\\n").replace('"', '\\"'), "Boil.\n\nPour.\nWait five minutes."),
    ],
)
def test_body(spark, text, want):
    assert value(spark, extract.body(F.lit(text))) == want


@pytest.mark.parametrize("text,want", [(ENVELOPE, "Tea & Cups"), ("no properties", None), ('<properties>{"title": 3}</properties>', None), ("<properties>{bad}</properties>", None)])
def test_title(spark, text, want):
    assert value(spark, extract.title(F.lit(text))) == want


@pytest.mark.parametrize(
    "text,want",
    [
        (f"https://wiki.example/{HEX}", [A]),
        (f"&lt;page url=&quot;https://wiki.example/{A}&quot;&gt;", [A]),
        (f"https://wiki.example/teapot wiki.example/page-{HEX} wiki.example/p/{HEX.upper()}", [A, A]),
        (f"https://wiki.example/dead-beef-{HEX}?v=1", [A]),
        ("https://wiki.example/1234", []),
        (f"https://other.example/{HEX}", []),
    ],
)
def test_ids(spark, text, want):
    assert value(spark, extract.ids(F.lit(text))) == want


@pytest.mark.parametrize("name,want", [("Tea & Two  Cups", "tea--two-cups"), ("v1.2_b-C!", "v1.2_b-c"), ("", "untitled"), ("x" * 99, "x" * 80), ("a\u00a0b", "a-b")])
def test_slug(spark, name, want):
    assert value(spark, extract.slugify(F.lit(name))) == want


@pytest.mark.parametrize(
    "source,target,want",
    [("a/b.md", "a/c.md", "./c.md"), ("a/index.md", "a/sub/page.md", "./sub/page.md"), ("a/b.md", "x/y.md", "../x/y.md"), ("b.md", "c.md", "./c.md"), ("a/b/c/d.md", "a/e.md", "../../e.md"), ("a/b.md", "a.md", "../a.md"), ("a/b/c.md", "a/b.md", "../b.md")],
)
def test_relative_path(spark, source, target, want):
    assert value(spark, extract.relative_path(F.lit(source), F.lit(target))) == want


@pytest.mark.parametrize("folder,target,want", [("a/b", "../c.md", "a/c.md"), ("", "./x.md", "x.md"), ("a", "../../x.md", "../x.md"), ("a/b", "./c/../d.md", "a/b/d.md")])
def test_normal_path(spark, folder, target, want):
    assert value(spark, extract.normal_path(F.lit(folder), F.lit(target))) == want


def test_managed_links(spark):
    inside = extract.managed_link(F.lit("index.md"), F.lit(A), F.lit("Kettle"), F.lit("kitchen/kettle.md"))
    assert value(spark, inside) == f'[Kettle](./kitchen/kettle.md) <!-- tree:child page_id="{A}" -->'
    outside = extract.managed_link(F.lit("index.md"), F.lit(A), F.lit(" O]u)t\n"), F.lit(None).cast("string"))
    assert value(spark, outside) == f'[O\\]u\\)t](https://wiki.example/{A}) <!-- tree:child page_id="{A}" external -->'


@pytest.mark.parametrize("url,want", [(f"https://wiki.example/T-{HEX}", A), (HEX, A), (A, A), (f"https://wiki.example/{HEX}?v=abc", None), ("https://wiki.example/collection/x", None), ("nothing", None)])
def test_parent_id(spark, url, want):
    assert value(spark, extract.parent_id_of_url(F.lit(url))) == want


def test_merged_section(spark):
    assert value(spark, extract.merged_section(extract.conflict_file(F.lit("l1\nl2"), F.lit("r")))) == "l1\nl2"


@pytest.mark.parametrize(
    "patterns,path,want",
    [
        (["*.md"], "a/b.md", True), (["a/**"], "a/b/c.md", True), (["a/**", "!a/b/*"], "a/b/c.md", False), (["/x.md"], "a/x.md", False), (["/x.md"], "x.md", True),
        (["a/"], "a/b.md", True), (["**/z.md"], "z.md", True), (["a/*/c.md"], "a/b/d/c.md", False), ([], "x", False), (["draft?.md"], "p/draft1.md", True), (["!x.md", "x.md"], "x.md", True),
    ],
)
def test_ignore(spark, patterns, path, want):
    assert value(spark, ignore.ignored(F.lit(path), patterns)) is want


@pytest.mark.parametrize("patterns,path,want", [(["a/*"], "a/b/c.md", True), (["*.md"], "a/b.md", True), (["a/**"], "a/b/c.md", False), (["[ab].md"], "x/a.md", True)])
def test_compatible_ignore(spark, patterns, path, want):
    assert value(spark, ignore.ignored(F.lit(path), patterns, compatible=True)) is want


def test_ignore_lines():
    assert ignore.patterns_of([" a ", "", "# no", "!b"]) == ["a", "!b"]


@pytest.mark.parametrize(
    "remote,want",
    [
        ("boil\npour\nwait\n", ("ok", None, None)),
        ("boil\npour\nwait", ("race_lost", None, None)),
        ("reboil\npour\nwait\n", ("race_lost", None, None)),
        ("boil\nstir\nwait\n", ("race_lost", None, None)),
        ("boil\npour\nwait\nsip\nboil\npour\nwait\n", ("ambiguous", 2, None)),
        ("<toggle>\nboil\npour\nwait\n</toggle>\n", ("rich_block_overlap", None, [0, 33])),
        ("boil\npour\nwait\n![cup](c.png)\n", ("ok", None, None)),
    ],
)
def test_hunks(remote, want):
    ((n, old, new),) = kernels.build_hunks("boil\npour\nwait\n", "boil\npour slowly\nwait\n")
    assert (n, old, new) == (0, "boil\npour\nwait\n", "boil\npour slowly\nwait\n")
    assert kernels.judge_hunk(old, remote, kernels.rich_spans(remote)) == want


def test_hunks_at_the_ends_and_apart():
    assert kernels.build_hunks("a\nb\n", "a\nb\nc\n") == [(0, "b\n", "b\nc\n")]
    assert kernels.build_hunks("a\nb\nc\nd\ne\n", "A\nb\nc\nd\n") == [(0, "a\nb\n", "A\nb\n"), (1, "d\ne\n", "d\n")]
    assert kernels.build_hunks("", "x\n") == [(0, "", "x\n")] and kernels.build_hunks("x", "x") == []
    assert kernels.judge_hunk("", "", []) == ("ok", None, None) and kernels.judge_hunk("", "a\nb", [])[0] == "ambiguous"


def test_broken_rules():
    text = "boil\npour\nwait\n"
    assert kernels.broken_rules("boil\npour\n", text, text) == []
    assert kernels.broken_rules("pour\n", text, text) == ["context"]
    assert kernels.broken_rules("boil\npo", text, text) == ["whole_lines", "line_bounded"]
    assert kernels.broken_rules("boil\npour\n", text, text + text) == ["unique"]
    assert kernels.broken_rules("boil\npour\n", text, "re" + text) == ["line_bounded"]
    assert kernels.broken_rules("boil\npour\n", text, "sip\n") == ["unique"]


def test_natural_key(spark):
    df = spark.createDataFrame([("a/10.md",), ("a/9.md",), ("a/b.md",)], "p string")
    assert [r.p for r in df.orderBy(graph.natural_key(F.col("p"))).collect()] == ["a/9.md", "a/10.md", "a/b.md"]
