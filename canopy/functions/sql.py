"""Names under which the column functions can be called from SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from canopy.functions import kernels
from canopy.functions import patterns as P

KERNELS = {
    "tree_nfc": kernels.nfc,
    "tree_sweep_tags": kernels.swept,
    "tree_unknown_tags": kernels.unknown_tags,
    "tree_pipe_tables": kernels.pipe_tables,
    "tree_unescape": kernels.unescape,
    "tree_hunks": kernels.hunks,
    "tree_unified_diff": kernels.unified_diff,
    "tree_rich_spans": kernels.rich_block_spans,
}

EXPRESSIONS = {
    "tree_fingerprint(t STRING)": ("STRING", "concat('sha256:', sha2(t, 256))"),
    "tree_line_ends(t STRING)": ("STRING", r"replace(replace(t, '\r\n', '\n'), '\r', '\n')"),
    "tree_unescape_prose(t STRING)": ("STRING", rf"regexp_replace(t, r'\\([{P.ESCAPED}])', '$1')"),
    "tree_slug(t STRING)": (
        "STRING",
        rf"coalesce(nullif(substring(regexp_replace(regexp_replace(lower(t), r'(?U)\s+', '-'), r'[^a-z0-9\-_.]', ''), 1, {P.SLUG_LENGTH}), ''), 'untitled')",
    ),
    "tree_dashed(h STRING)": ("STRING", "concat_ws('-', substring(h, 1, 8), substring(h, 9, 4), substring(h, 13, 4), substring(h, 17, 4), substring(h, 21, 12))"),
    "tree_basename(p STRING)": ("STRING", "element_at(split(p, '/'), -1)"),
}


def register(spark: SparkSession) -> list[str]:
    """Register all functions for this session; returns their names."""
    for name, kernel in KERNELS.items():
        spark.udf.register(name, kernel)
    for head, (kind, body) in EXPRESSIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
    return [*KERNELS, *(head.split("(")[0] for head in EXPRESSIONS)]
