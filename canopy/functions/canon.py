"""The canonical form of a page's text as column expressions.

Order: decode, compose, line ends; remote only: rich tags, then unknown tags; page tags; title line, HTML tables, prose
between code fences; then the lines: image lines (remote), link lines and page lines go, ends are trimmed; one newline
at the end. What takes Python is given only the texts that need it (characters beyond U+02FF, tags, tables); of all
others nothing crosses to a worker. Every step is bound to a name of its own, so that no expression is repeated inside
another and generated code stays small.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.functions import kernels
from canopy.functions import patterns as P

def bound(text: Column, *steps) -> Column:
    """The steps one after the other, each over a value that is computed once."""
    for step in steps:
        text = F.get(F.transform(F.array(text), step), F.lit(0))
    return text


def decode(content: Column) -> Column:
    """Strict UTF-8: raises on malformed bytes."""
    return F.decode(content, "UTF-8")


def line_ends(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def drop_all(text: Column, patterns: list[str]) -> Column:
    return reduce(lambda c, p: F.regexp_replace(c, p, ""), patterns, text)


def strip_rich_tags(text: Column) -> Column:
    cleaned = drop_all(text, [P.paired(t) for t in P.PAIRED_TAGS] + [P.single(t) for t in P.SINGLE_TAGS])
    return F.when(F.contains(text, F.lit("<")), cleaned).otherwise(text)


def strip_page_tags(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("<")), drop_all(text, [P.PAGE_SPAN, P.PAGE_TAG])).otherwise(text)


def is_blank(line: Column) -> Column:
    return line.rlike("(?U)^" + P.BLANK + r"*\z")


def trim_end(line: Column) -> Column:
    return F.regexp_replace(line, "(?U)" + P.BLANK + r"+\z", "")


def trim_both(line: Column) -> Column:
    return F.regexp_replace(line, "(?U)^" + P.BLANK + "+|" + P.BLANK + r"+\z", "")


def heading(line: Column) -> Column:
    """Title of a first-level heading line, else empty."""
    return F.regexp_extract(line, r"(?s)^ {0,3}#[ \t]+(.+?)[ \t]*\z", 1)


def strip_title(text: Column, title: Column) -> Column:
    """Without the first non-blank line (and one blank line after it) where that is the title as a heading."""
    top = r"^((?:[^\S\n]*\n)*) {0,3}#[ \t]+"
    # the heading and what it says, from the text's begin only
    head = F.regexp_extract(text, "(?U)" + top + r"([^\n]+?)[ \t]*(?:\n|\z)", 2)
    rest = F.regexp_replace(text, "(?U)" + top + r"[^\n]*(?:\n|\z)(?:[^\S\n]*(?:\n|\z))?", "$1")
    # nothing but blanks is left of a text that had no newline at its end
    bare = F.endswith(rest, F.lit("\n")) & ~F.endswith(text, F.lit("\n")) & ~rest.rlike(r"(?U)\S")
    ended = F.when(bare, F.regexp_replace(rest, r"\n\z", "")).otherwise(rest)
    return F.when((title != "") & (head == title), ended).otherwise(text)


def _separator(line: Column) -> Column:
    bare = F.regexp_replace(line, r"^[ \t]*\||\|[ \t]*\z", "")
    cells = F.transform(F.split(bare, r"\|", -1), lambda c: F.trim(F.translate(c, "\t", " ")))
    shown = F.transform(cells, lambda c: F.concat(F.when(F.startswith(c, F.lit(":")), ":").otherwise(""), F.lit("---"), F.when(F.endswith(c, F.lit(":")), ":").otherwise("")))
    return F.concat(F.lit("| "), F.array_join(shown, " | "), F.lit(" |"))


def table_separators(text: Column) -> Column:
    """Separator rows of pipe tables in one form, alignment kept."""
    lines = F.transform(F.split(text, "\n", -1), lambda x: F.when(x.rlike(P.SEPARATOR_LINE), _separator(x)).otherwise(x))
    return F.when(text.rlike(r"(?m)^[ \t]*\|[ \t:]*-"), F.array_join(lines, "\n")).otherwise(text)


def unescape_prose(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([" + P.ESCAPED + "])", "$1")


def unwrap_bare_domains(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\[([^\s\]\)]+)\]\(https?://\1\)", "$1")


def unwrap_autolinks(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\[((?:https?|mailto):[^\s\]\)]+)\]\(\1\)", "$1")


def collapse_blank_lines(text: Column) -> Column:
    return F.regexp_replace(text, r"\n{2,}", "\n")


def prose(text: Column) -> Column:
    unwrapped = lambda x: F.when(F.contains(x, F.lit("](")), unwrap_autolinks(unwrap_bare_domains(x))).otherwise(x)
    return bound(text, table_separators, unescape_prose, unwrapped, collapse_blank_lines)


def fenced(block: Column) -> Column:
    """A code block without its language and without blanks at its end."""
    return F.regexp_replace(F.regexp_replace(block, r"^([ \t]{0,3}```)[a-zA-Z0-9_+\-]*[ \t]*\n", "$1\n"), r"[ \t]+\z", "")


def prose_and_code(text: Column) -> Column:
    """Prose in canonical form, code blocks verbatim but for fence and language."""
    parts = F.transform(F.split(text, P.FENCE, -1), prose)
    blocks = F.transform(F.regexp_extract_all(text, F.lit(P.FENCE), F.lit(0)), fenced)
    woven = F.array_join(F.flatten(F.zip_with(parts, blocks, lambda p, b: F.array(p, F.coalesce(b, F.lit(""))))), "")
    return F.when(F.contains(text, F.lit("```")), woven).otherwise(prose(text))


def dropped_line(line: Column, remote: bool, dialect: P.Dialect = P.DEFAULT) -> Column:
    s = trim_both(line)
    out = s.rlike("(?U)" + dialect.managed) | s.rlike("(?U)" + dialect.placeholder) | s.rlike(P.PAGE_LINE)
    return out | s.rlike("(?U)" + P.IMAGE_LINE) if remote else out


def line_pass(text: Column, remote: bool, dialect: P.Dialect = P.DEFAULT) -> Column:
    lines = F.split(text, "\n", -1)
    some = text.rlike(r"(?i)<!--|<page|!\[") if remote else text.rlike("(?i)<!--|<page")
    kept = F.when(some, F.filter(lines, lambda x: ~dropped_line(x, remote, dialect))).otherwise(lines)
    return F.array_join(F.transform(kept, trim_end), "\n")


def last_newline(text: Column) -> Column:
    return bound(F.regexp_replace(text, r"\n+\z", ""), lambda bare: F.when(bare == "", bare).otherwise(F.concat(bare, F.lit("\n"))))


def _where(pattern: str, kernel):
    """``kernel`` for the texts that have the pattern; it sees nulls in place of the others.

    Marked as not deterministic, so that its projection is not merged into others and it runs once.
    """
    once = kernel.asNondeterministic()
    return lambda text: F.coalesce(once(F.when(text.rlike(pattern), text)), text)


#: What Python does, and the texts that need it.
COMPOSE, SWEEP, TABLES = (r"[^\x{0}-\x{2FF}]", kernels.nfc), ("<[A-Za-z]", kernels.swept), ("(?i)<table", kernels.pipe_tables)


def _steps(mode: str, title: Column | None, dialect: P.Dialect, python) -> list:
    """Steps in order, each from a column to a column; ``python(pattern, kernel)`` makes those of Python."""
    if mode not in {"local", "remote"}:
        raise ValueError(mode)
    remote = mode == "remote"
    titled = [] if title is None else [lambda text: strip_title(text, title)]
    tags = [lambda text: bound(text, line_ends, strip_rich_tags), python(*SWEEP), lambda text: bound(text, strip_page_tags, *titled)]
    plain = [lambda text: bound(text, line_ends, strip_page_tags, *titled)]
    lines = lambda text: bound(text, prose_and_code, lambda x: line_pass(x, remote, dialect), last_newline)
    return [python(*COMPOSE), *(tags if remote else plain), python(*TABLES), lines]


def normalize(text: Column, mode: str = "local", title: Column | None = None, dialect: P.Dialect = P.DEFAULT) -> Column:
    """The canonical form as one column; every text goes through Python. For whole tables take ``canonical``."""
    return reduce(lambda c, step: step(c), _steps(mode, title, dialect, lambda pattern, kernel: kernel), text)


def canonical(df: DataFrame, text: str, out: str, mode: str = "local", title: Column | None = None, dialect: P.Dialect = P.DEFAULT) -> DataFrame:
    """``df`` plus column ``out`` (or with it replaced), in one pass over ``df``. Null texts stay null."""
    kernels.small_batches(df.sparkSession)
    rows = df.withColumn("__text", F.col(text)) if title is None else df.withColumns({"__text": F.col(text), "__title": title})
    for step in _steps(mode, None if title is None else F.col("__title"), dialect, _where):
        rows = rows.withColumn("__text", step(F.col("__text")))
    return rows.withColumn(out, F.col("__text")).drop("__text", "__title")


def fingerprint(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def strip_child_links(text: Column, dialect: P.Dialect = P.DEFAULT) -> Column:
    """Line ends unified and link lines dropped, nothing else."""
    lines = F.filter(F.split(line_ends(text), "\n", -1), lambda x: ~(trim_both(x).rlike("(?U)" + dialect.managed) | trim_both(x).rlike("(?U)" + dialect.placeholder)))
    return F.array_join(lines, "\n")
