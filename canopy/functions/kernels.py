"""Arrow UDFs for what column expressions can't say: composition, tag sweep, HTML tables, line diffs.

All are pure: warnings come back as columns, so a task may run twice. Of a batch only ``PIECE`` rows at once are Python
objects, and ``small_batches`` bounds what a worker is sent: its memory does not depend on the table's size.
"""

from __future__ import annotations

import difflib
import re
import unicodedata
from collections.abc import Callable
from html.parser import HTMLParser
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopy.functions import patterns as P

#: Types as objects: a worker that imports this module has no session to parse DDL with.
_TEXT, _INT = T.StringType(), T.IntegerType()
HUNKS = T.ArrayType(
    T.StructType().add("hunk_index", _INT).add("old_str", _TEXT).add("new_str", _TEXT).add("verdict", _TEXT).add("match_count", _INT).add("overlap", T.ArrayType(_INT))
)
SPANS = T.ArrayType(T.StructType().add("begin", _INT).add("end", _INT).add("type", _TEXT))

_KEEP_PAIRED = set(P.PAIRED_TAGS) | {"page"} | P.HTML_TAGS
_KEEP_SINGLE = _KEEP_PAIRED | set(P.SINGLE_TAGS)
_TAG = re.compile(r"<([a-z][a-z0-9_-]*)\b[^>]*>", re.I)
_TABLE = re.compile(r"<table\b[^>]*>.*?</table>", re.S | re.I)


#: Rows of a batch that are Python objects at once, and rows that go to a worker at once.
PIECE = 128


def small_batches(spark: SparkSession) -> None:
    """At most ``PIECE`` rows go to a Python worker at once: whole texts in the default of ten thousand take much memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= PIECE:
        spark.conf.set(name, str(PIECE))


def _by_rows(f: Callable, kind: pa.DataType, *columns: pa.Array) -> pa.Array:
    """``f`` of the values of each row; null where one of them is null."""
    done = [pa.array([], kind)]
    for at in range(0, len(columns[0]), PIECE):
        rows = zip(*[c.slice(at, PIECE).to_pylist() for c in columns], strict=True)
        done.append(pa.array([None if any(x is None for x in r) else f(*r) for r in rows], kind))
    return done[1] if len(done) == 2 else pa.concat_arrays(done)


def _strings(column: pa.Array, f) -> pa.Array:
    return _by_rows(f, pa.string(), column)


@F.arrow_udf(T.StringType())
def nfc(text: pa.Array) -> pa.Array:
    """Unicode canonical composition."""
    return _strings(text, lambda x: unicodedata.normalize("NFC", x))


def _names(tag: str) -> list[str]:
    """What a tag may be closed by: its name, or a beginning of it that ends with a word (``a`` of ``a-b``)."""
    ends = [i for i in range(len(tag), 0, -1) if i == len(tag) or (tag[i - 1] == "-") != (tag[i] == "-")]
    return [tag[:i] for i in ends if i < len(tag) or tag[-1] != "-"]


def _spans(text: str):
    """Begin, end and name of elements, from left to right; none lies in or over another."""
    folded, at = text.lower(), 0
    if len(folded) != len(text):  # a letter whose lower case is two
        folded = "".join(c.lower() if c.isascii() else c for c in text)
    while tag := _TAG.search(text, at):
        at = tag.start() + 1
        for name in _names(tag[1].lower()):
            close = folded.find(f"</{name}>", tag.end())
            if close >= 0:
                at = close + len(name) + 3
                yield tag.start(), at, name
                break


def sweep(text: str) -> tuple[str, list[str]]:
    """``text`` without elements and single tags of unknown names, and these names in order of their finding.

    An element of a known name is kept whole; single tags of unknown names go inside it as well.
    """
    gone, kept, last = [], [], 0
    for begin, end, name in _spans(text):
        if name not in _KEEP_PAIRED:
            kept.append(text[last:begin])
            gone.append(name)
            last = end
    kept.append(text[last:])
    pieces, last, left = [], 0, "".join(kept)
    for tag in _TAG.finditer(left):
        if tag[1].lower() not in _KEEP_SINGLE:
            pieces.append(left[last : tag.start()])
            gone.append(tag[1].lower())
            last = tag.end()
    return "".join([*pieces, left[last:]]), list(dict.fromkeys(gone))


@F.arrow_udf(T.StringType())
def swept(text: pa.Array) -> pa.Array:
    return _strings(text, lambda x: sweep(x)[0])


@F.arrow_udf(T.ArrayType(T.StringType()))
def unknown_tags(text: pa.Array) -> pa.Array:
    return _by_rows(lambda x: sweep(x)[1], pa.list_(pa.string()), text)


class _Events(HTMLParser):
    """The tokens of some markup: ("open", tag, names of its attributes), ("close", tag) and ("text", data)."""

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.seen: list[tuple] = []
        self.handle_starttag = lambda tag, attrs: self.seen.append(("open", tag, {a for a, _ in attrs}))
        self.handle_endtag = lambda tag: self.seen.append(("close", tag))
        self.handle_data = lambda data: self.seen.append(("text", data))
        self.feed(html)
        self.close()


def pipe_table(html: str) -> str | None:
    """The table as a pipe table whose first row is the header; None if it can't be shown as one.

    That is: one table, no cell over several rows or columns, rows of one width. Only cells that end inside a row count.
    """
    try:
        events = _Events(html).seen
    except Exception:  # a parser error means: leave it as it is
        return None
    if [e[:2] for e in events].count(("open", "table")) > 1:
        return None
    table, row, cell = [], None, None
    for event in events:
        match event:
            case "open", "td" | "th", attributes:
                if attributes & {"rowspan", "colspan"}:
                    return None
                cell = []
            case "text", data if cell is not None:
                cell.append(data)
            case "close", "td" | "th":
                if row is not None and cell is not None:
                    row.append("".join(cell).strip().replace("\n", " ").replace("|", "\\|"))
                cell = None
            case "open", "tr", _:
                row = []
            case "close", "tr" if row is not None:
                table.append(row)
                row = None
    if not table or len({len(r) for r in table}) > 1:
        return None
    table.insert(1, ["---"] * len(table[0]))
    return "".join(f"| {' | '.join(r)} |\n" for r in table)


@F.arrow_udf(T.StringType())
def pipe_tables(text: pa.Array) -> pa.Array:
    """Every table span as a pipe table, or as it is."""
    return _strings(text, lambda x: _TABLE.sub(lambda m: m[0] if (t := pipe_table(m[0])) is None else t, x))


@F.arrow_udf(T.StringType())
def unescape(text: pa.Array) -> pa.Array:
    """Backslash escapes of JSON strings decoded; anything else stays."""
    names = {"n": "\n", "r": "\r", "t": "\t", '"': '"', "\\": "\\", "/": "/"}
    code = re.compile(r'\\(?:u([0-9a-fA-F]{4})|([nrt"\\/]))')
    return _strings(text, lambda x: code.sub(lambda m: chr(int(m[1], 16)) if m[1] else names[m[2]], x))


def build_hunks(snapshot: str, local: str) -> list[tuple[int, str, str]]:
    """What lies between the lines that both texts share, with one shared line on each side where there is one."""
    old, new = snapshot.splitlines(keepends=True), local.splitlines(keepends=True)
    out, i, j = [], 0, 0
    for shared in difflib.SequenceMatcher(None, old, new, False).get_matching_blocks():
        if (i, j) != (shared.a, shared.b):
            out.append((len(out), "".join(old[max(i - 1, 0) : shared.a + 1]), "".join(new[max(j - 1, 0) : shared.b + 1])))
        i, j = shared.a + shared.size, shared.b + shared.size
    return out


_SPANS = [re.compile(P.paired(t)) for t in P.PAIRED_TAGS] + [re.compile("(?m)" + P.IMAGE_LINE)]


def rich_spans(text: str) -> list[tuple[int, int, str]]:
    """Begin, end and type of rich spans and image lines."""
    names = [*P.PAIRED_TAGS, "image"]
    return [(*m.span(), name) for name, pattern in zip(names, _SPANS, strict=True) for m in pattern.finditer(text)]


def line_places(part: str, text: str) -> list[tuple[int, int]]:
    """Where the lines of ``part`` stand in ``text`` as whole lines: begin and end in characters, overlaps among them."""
    lines, wanted = text.split("\n"), part.removesuffix("\n").split("\n")
    if not part:  # nothing stands at the begin of every line
        wanted = []
    begins = list(accumulate((len(x) + 1 for x in lines), initial=0))
    last = len(lines) - len(wanted) - (1 if part.endswith("\n") else 0)  # the last line has no newline after it
    return [(begins[n], begins[n] + len(part)) for n in range(min(last, len(lines) - 1) + 1) if lines[n : n + len(wanted)] == wanted]


def judge_hunk(old: str, remote: str, spans: list[tuple[int, int, str]]) -> tuple[str, int | None, list[int] | None]:
    """Verdict, number of matches if ambiguous, and the rich span met if any."""
    match line_places(old, remote):
        case []:
            return "race_lost", None, None
        case [(begin, end)]:
            inside = [[s, e] for s, e, _ in spans if max(s, begin) < min(e, end)]
            return ("rich_block_overlap", None, inside[0]) if inside else ("ok", None, None)
        case several:
            return "ambiguous", len(several), None


RULES = T.ArrayType(_TEXT)


def broken_rules(old: str, snapshot: str, remote: str) -> list[str]:
    """Which rules a hunk's ``old`` breaks: whole_lines and context (in the snapshot), line_bounded and unique (in the remote text)."""
    out, mine = [], line_places(old, snapshot)
    if not mine:
        out.append("whole_lines")
    elif not any((b == 0 or old.count("\n") > 1) and (e >= len(snapshot) or old.count("\n") > 1) for b, e in mine):
        out.append("context")
    there = line_places(old, remote)
    if old not in remote:
        out.append("unique")
    elif not there or remote.count(old) > len(there):
        out.append("line_bounded")
    if len(there) > 1:
        out.append("unique")
    return out


@F.arrow_udf(RULES)
def hunk_rules(old: pa.Array, snapshot: pa.Array, remote: pa.Array) -> pa.Array:
    """The rules that each hunk breaks; null where a text is null."""
    return _by_rows(broken_rules, pa.list_(pa.string()), old, snapshot, remote)


HUNK = pa.struct([("hunk_index", pa.int32()), ("old_str", pa.string()), ("new_str", pa.string()), ("verdict", pa.string()), ("match_count", pa.int32()), ("overlap", pa.list_(pa.int32()))])


@F.arrow_udf(HUNKS)
def hunks(snapshot: pa.Array, local: pa.Array, remote: pa.Array) -> pa.Array:
    """Hunks from snapshot to local, judged against remote; null where one of the texts is null."""

    def one(s: str, x: str, r: str) -> list[dict]:
        spans, rows = rich_spans(r), []
        for n, old, new in build_hunks(s, x):
            verdict, count, met = judge_hunk(old, r, spans)
            rows.append({"hunk_index": n, "old_str": old, "new_str": new, "verdict": verdict, "match_count": count, "overlap": met})
        return rows

    return _by_rows(one, pa.list_(HUNK), snapshot, local, remote)


@F.arrow_udf(T.StringType())
def unified_diff(snapshot: pa.Array, local: pa.Array) -> pa.Array:
    """Unified diff of two texts, labelled snapshot and local."""

    def one(a: str, b: str) -> str:
        return "".join(difflib.unified_diff(a.splitlines(keepends=True), b.splitlines(keepends=True), fromfile="snapshot", tofile="local"))

    return _by_rows(one, pa.string(), snapshot, local)


@F.arrow_udf(SPANS)
def rich_block_spans(text: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("type", pa.string())]))
    return _by_rows(lambda x: [{"begin": s, "end": e, "type": t} for s, e, t in rich_spans(x)], kind, text)


CATALOGUE = T.ArrayType(T.StructType().add("type", _TEXT).add("anchor", _TEXT).add("summary", _TEXT))
_HEADING = re.compile(r"^#{1,6}[ \t]+(.*?)[ \t]*$", re.M)
#: Characters of a block's summary.
SUMMARY = 80


@F.arrow_udf(CATALOGUE)
def rich_catalogue(text: pa.Array) -> pa.Array:
    """Of the rich spans in order: type, the heading before (empty if none), and the beginning of what they say."""

    def one(x: str) -> list[dict]:
        heads, out = [(m.end(), m[1]) for m in _HEADING.finditer(x)], []
        for begin, end, kind in sorted(rich_spans(x)):
            anchor = next((name for at, name in reversed(heads) if at <= begin), "")
            said = " ".join(re.sub(r"<[^>]*>|^!\[|\]\(.*$", " ", x[begin:end]).split())
            out.append({"type": kind, "anchor": anchor, "summary": said[:SUMMARY]})
        return out

    kind = pa.list_(pa.struct([("type", pa.string()), ("anchor", pa.string()), ("summary", pa.string())]))
    return _by_rows(one, kind, text)
