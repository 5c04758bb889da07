"""Parts of envelopes, ids, titles, slugs, paths and links as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from canopy.functions import canon, kernels
from canopy.functions import patterns as P


def recover_json(text: Column) -> Column:
    """The string under "text" where the input is a JSON object that holds one near its begin, else the input."""
    bare = F.regexp_replace(text, r"(?U)^\s+", "")
    wrapped = F.startswith(bare, F.lit("{")) & F.contains(F.substring(bare, 1, 512), F.lit('"text"'))
    parsed = F.try_parse_json(bare)
    found = F.try_variant_get(parsed, "$.text", "string")
    is_string = F.schema_of_variant(F.try_variant_get(parsed, "$.text", "variant")) == "STRING"
    return F.when(wrapped & F.coalesce(is_string, F.lit(False)), found).otherwise(text)


def is_escaped(text: Column) -> Column:
    """Many literal \\n and hardly a newline in the first 2048 characters."""
    sample = F.substring(text, 1, 2048)
    literal = (F.length(sample) - F.length(F.replace(sample, F.lit("\\n"), F.lit("")))) / 2
    real = F.length(sample) - F.length(F.replace(sample, F.lit("\n"), F.lit("")))
    return (literal >= 5) & (real <= 1)


def recover(text: Column, unescape: bool = True) -> Column:
    """The envelope as it was before it was wrapped in JSON or its escapes were left undecoded."""
    found = recover_json(text)
    if not unescape:
        return found
    # only what is escaped goes through Python
    return F.coalesce(kernels.unescape(F.when(found.eqNullSafe(text) & is_escaped(text), text)), found)


def element(text: Column, tag: str) -> Column:
    """What the first ``<tag ...>`` encloses, without a newline at either side; the whole text if there is none."""
    pattern = rf"(?is)<{tag}(?:\s[^>]*)?>\n?(.*?)\n?</{tag}>"
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1)).otherwise(text)


def body(text: Column, unescape: bool = True) -> Column:
    return canon.bound(recover(text, unescape), lambda whole: element(whole, "content"))


def title(text: Column) -> Column:
    """The string title among the properties; null without one."""
    block = F.regexp_extract(text, r"(?is)<properties>\s*(\{.*?\})\s*</properties>", 1)
    parsed = F.try_variant_get(F.try_parse_json(F.nullif(block, F.lit(""))), "$.title", "variant")
    return F.when(F.schema_of_variant(parsed) == "STRING", F.try_variant_get(parsed, "$", "string"))


def dashed(hex32: Column) -> Column:
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat_ws("-", *[F.substring(hex32, a, n) for a, n in cuts])


def ids(text: Column, dialect: P.Dialect = P.DEFAULT) -> Column:
    """Ids of page urls in order, repeats kept: the last 32 hex digits of the path."""
    plain = text
    for code, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(code), F.lit(char))
    paths = F.regexp_extract_all(plain, F.lit(dialect.page_url), F.lit(1))
    digits = F.transform(paths, lambda p: F.lower(F.substring(F.replace(p, F.lit("-"), F.lit("")), -32, 32)))
    return F.transform(F.filter(digits, lambda d: d.rlike("^[0-9a-f]{32}$")), dashed)


def child_ids(text: Column, dialect: P.Dialect = P.DEFAULT) -> Column:
    """Ids of page tags that are lines of their own; mentions in running text don't count."""
    lines = F.filter(F.split(text, "\n"), lambda x: canon.trim_both(x).rlike(P.PAGE_LINE))
    return F.flatten(F.transform(lines, lambda x: ids(x, dialect)))


def parent_id_of_url(url: Column) -> Column:
    """Id of a page url or a bare id; null for database views and collections."""
    plain = F.regexp_extract(url, "^(?:.*[/-])?((?i)[0-9a-f]{32}|" + P.ID + r")(?:[?#].*)?$", 1)
    good = (plain != "") & ~url.rlike(r"[?&]v=|/collection")
    return F.when(good, dashed(F.lower(F.replace(plain, F.lit("-"), F.lit("")))))


def slugify(name: Column) -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.lower(name), r"(?U)\s+", "-"), r"[^a-z0-9\-_.]", "")
    slug = F.substring(slug, 1, P.SLUG_LENGTH)
    return F.when(slug == "", F.lit("untitled")).otherwise(slug)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirname(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def relative_path(source: Column, target: Column) -> Column:
    """The way from the folder of ``source`` to ``target``, beginning with ./ or ../."""
    here = F.when(dirname(source) == "", F.array().cast("array<string>")).otherwise(F.split(dirname(source), "/"))
    there = F.split(target, "/")
    same = F.zip_with(here, there, lambda a, b: F.coalesce(a == b, F.lit(False)))
    split_at = F.array_position(same, F.lit(False)).cast("int")
    shared = F.least(F.when(split_at > 0, split_at - 1).otherwise(F.size(same)), F.size(here), F.size(there) - 1)
    up = F.repeat(F.lit("../"), F.size(here) - shared)
    down = F.array_join(F.slice(there, shared + 1, F.size(there)), "/")
    path = F.concat(up, down)
    return F.when(F.startswith(path, F.lit(".")), path).otherwise(F.concat(F.lit("./"), path))


def normal_path(folder: Column, target: Column) -> Column:
    """``target`` seen from ``folder``, with . and .. resolved."""
    whole = F.when(folder == "", target).otherwise(F.concat(folder, F.lit("/"), target))
    empty = F.array().cast("array<string>")

    def add(done: Column, part: Column) -> Column:
        back = (part == "..") & (F.size(done) > 0) & (F.coalesce(F.get(done, F.size(done) - 1), F.lit("")) != "..")
        return F.when((part == ".") | (part == ""), done).when(back, F.slice(done, 1, F.size(done) - 1)).otherwise(F.concat(done, F.array(part)))

    return F.array_join(F.aggregate(F.split(whole, "/"), empty, add), "/")


def link_title(name: Column) -> Column:
    safe = F.replace(F.replace(F.replace(name, F.lit("]"), F.lit("\\]")), F.lit(")"), F.lit("\\)")), F.lit("\n"), F.lit(" "))
    return canon.trim_both(safe)


def managed_link(source: Column, target_id: Column, name: Column, target_path: Column, dialect: P.Dialect = P.DEFAULT) -> Column:
    """A managed link line; with an absolute url and the word external where ``target_path`` is null."""
    mark = F.concat(F.lit(f" <!-- {dialect.marker} page_id=\""), target_id, F.lit('"'))
    inside = F.concat(F.lit("["), link_title(name), F.lit("]("), relative_path(source, target_path), F.lit(")"), mark, F.lit(" -->"))
    outside = F.concat(F.lit("["), link_title(name), F.lit(f"]({dialect.base_url}"), target_id, F.lit(")"), mark, F.lit(" external -->"))
    return F.when(target_path.isNotNull(), inside).otherwise(outside)


def non_empty_body(text: Column, name: Column) -> Column:
    """Whether a canonical body holds more than its title."""
    return ~(F.trim(F.replace(text, F.lit("\n"), F.lit(" "))).isin("") | (F.regexp_replace(text, r"\n+\z", "") == F.concat(F.lit("# "), F.coalesce(name, F.lit("")))))


def title_of_new(text: Column, path: Column) -> Column:
    """The first heading, else the file's stem."""
    found = F.regexp_extract(text, r"(?m)^ {0,3}#[ \t]+(.+?)[ \t]*$", 1)
    return F.when(found != "", found).otherwise(F.regexp_replace(basename(path), r"(?i)\.md$", ""))


def placeholder_spans(text: Column) -> Column:
    """Rich spans shown by a placeholder, for diffs that people read."""
    for tag in P.PAIRED_TAGS:
        text = F.regexp_replace(text, P.paired(tag), f"[rich block: {tag}] (not synced)")
    return text


def conflict_file(local: Column, remote: Column) -> Column:
    """A scratch text of three labelled sections; only the merged one is read back."""
    return F.concat(F.lit("<!-- LOCAL -->\n"), local, F.lit("\n<!-- /LOCAL -->\n<!-- REMOTE -->\n"), remote, F.lit("\n<!-- /REMOTE -->\n<!-- MERGED -->\n"), local, F.lit("\n<!-- /MERGED -->\n"))


def merged_section(text: Column) -> Column:
    return F.regexp_extract(text, r"(?s)<!-- MERGED -->\n(.*?)\n?<!-- /MERGED -->", 1)


def error_message(symptom: Column) -> Column:
    """Setup errors told by what the remote answered."""
    return (
        F.when(symptom.rlike("(?i)<data-source"), "the url names a database, not a page")
        .when(symptom.rlike("(?i)404|not.?found"), "page not found or not shared")
        .when(symptom.rlike("(?i)401|403|unauthor|forbidden"), "no access")
        .when(symptom.rlike("(?i)429|rate"), "too many requests; try again later")
        .otherwise("unknown error")
    )
