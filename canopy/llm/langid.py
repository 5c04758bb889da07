"""Language identification by Bayesian evidence fusion.

The posterior of a language is proportional to the product of

* the likelihood of the text: hashed byte trigrams of lower-cased letters under a smoothed multinomial model of each
  language, trained on all rows whose declared language is one of the model's; a third of the log-likelihood counts,
  as each byte is in three trigrams;
* the likelihood of the declared markup language (``DECLARED_RIGHT`` for its own language, the rest shared out);
* the likelihood of the address suffix, for suffixes that stand for a language (``SUFFIX_RIGHT``);
* the prior of the host, smoothed hierarchically: counts of a host are smoothed by those of its suffix, these by those
  of all rows (``PRIOR_WEIGHT`` pseudo-counts each). The counts are of languages by text alone, in grouped aggregates.

A further class stands for text of no language of the model: its trigrams are drawn evenly from all buckets, and its
prior is ``OTHER``. So languages that were not trained and letters at random are rejected as ``und``, the surer the
larger the training text; texts that mix languages of the model stay with the likeliest. A few trigrams say little.

Missing evidence (null or unknown declared language, suffix or host) counts as none. Rows whose text is null or has
no three letters in a row, or in which the further class is likeliest, have language ``und`` and are rejected; so are rows whose language is not among ``accept``
or whose posterior is below ``least``. Repeated rows repeat; very long texts are taken whole, in pieces of bounded
size. An empty table gives an empty result. Further columns are carried by position, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.llm.shared import materialize, small_batches, trim_memory

LANGUAGES = ("de", "en", "es", "fr")
BUCKETS = 1 << 16
DECLARED_RIGHT, SUFFIX_RIGHT, PRIOR_WEIGHT = 0.9, 0.8, 20.0
#: The prior of text in no language of the model.
OTHER = 0.1
#: Suffixes that stand for one language.
SUFFIXES = {"de": "de", "at": "de", "uk": "en", "us": "en", "ie": "en", "es": "es", "mx": "es", "ar": "es", "fr": "fr"}

_FOLD = np.full(256, 32, np.uint8)  # letters lower-cased, bytes of other scripts as they are, all else blank
for _b in range(256):
    if chr(_b).isascii() and chr(_b).isalpha():
        _FOLD[_b] = ord(chr(_b).lower())
    elif _b >= 128:
        _FOLD[_b] = _b
PIECE = 256 << 10


def _trigrams(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """In pieces, the row and the bucket of every trigram; those with a blank are left out."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        last = row + 1
        while last < len(texts) and offsets[last + 1] - offsets[row] <= PIECE:
            last += 1
        for begin in range(int(offsets[row]), int(offsets[last]), PIECE):
            end = min(begin + PIECE, int(offsets[last]))  # a single long text goes in pieces that overlap by two bytes
            folded = _FOLD[data[begin : min(end + 2, int(offsets[last]))]]
            b = folded.astype(np.uint32)
            if len(b) < 3:
                continue
            key = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
            whole = (folded[:-2] != 32) & (folded[1:-1] != 32) & (folded[2:] != 32)
            bounds = np.clip(offsets[row : last + 1], begin, begin + len(key))
            owner = np.repeat(np.arange(row, last), np.diff(bounds))
            for cut in bounds[1:-1] if last > row + 1 else ():  # none over the end of a text
                whole[max(0, cut - begin - 2) : cut - begin] = False
            yield owner[whole], (key[whole] * np.uint32(2654435761)) >> np.uint32(16)
        row = last


def train(docs: DataFrame) -> np.ndarray:
    """Log-probabilities, languages and the further class x BUCKETS, from ``docs(text, declared)``: every row with a declared language of the model."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(LANGUAGES), BUCKETS), np.int64)
        for b in batches:
            kind = b.column(1).to_numpy(zero_copy_only=False)
            for rows, bucket in _trigrams(b.column(0)):
                total += np.bincount(kind[rows].astype(np.int64) * BUCKETS + bucket, minlength=total.size).reshape(total.shape)
        lang, bucket = np.nonzero(total)
        trim_memory()
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.int32()), pa.array(bucket, pa.int32()), pa.array(total[lang, bucket])], ["lang", "bucket", "n"])

    which = F.array_position(F.array(*[F.lit(x) for x in LANGUAGES]), F.col("declared")) - 1
    labelled = docs.where(F.col("declared").isin(*LANGUAGES)).select(F.coalesce("text", F.lit("")).alias("text"), which.cast("int").alias("lang"))
    counted = labelled.mapInArrow(count, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    model = np.full((len(LANGUAGES), BUCKETS), 0.5)
    got = counted.toPandas()  # languages x BUCKETS rows at most
    model[got["lang"].to_numpy(np.int64), got["bucket"].to_numpy(np.int64)] += got["n"].to_numpy(np.float64)
    model /= model.sum(axis=1, keepdims=True)
    return np.log(np.vstack((model, np.full(BUCKETS, 1 / BUCKETS))))


def text_likelihood(text: Column, model) -> Column:
    """array<double>: number of trigrams, then the log-likelihood under each class. ``model``: a broadcast of train()."""

    @F.arrow_udf("array<double>")
    def run(texts: pa.Array) -> pa.Array:
        out = np.zeros((len(texts), 1 + len(model.value)))
        for rows, bucket in _trigrams(texts):
            out[:, 0] += np.bincount(rows, minlength=len(texts))
            for i, logs in enumerate(model.value):
                out[:, i + 1] += np.bincount(rows, weights=logs[bucket], minlength=len(texts))
        return pa.array(out.tolist(), pa.list_(pa.float64()))

    return run(F.coalesce(text, F.lit("")))


def suffix_of(address: Column) -> Column:
    """The last label of the host of an address or url, lower-cased; null without one."""
    return F.nullif(F.lower(F.regexp_extract(address, r"(?:^|://)[^/?#:]*\.([A-Za-z]+)(?=[:/?#]|$)", 1)), F.lit(""))


def identify(
    rows: DataFrame,
    text: Column,
    declared: Column | None = None,
    host: Column | None = None,
    suffix: Column | None = None,
    accept: tuple[str, ...] = LANGUAGES,
    least: float = 0.5,
) -> DataFrame:
    """``rows`` plus lang_id, lang_prob and lang_ok. The evidence is given as columns over ``rows``; their types are string."""
    spark = rows.sparkSession
    small_batches(spark)
    none = F.lit(None).cast("string")
    declared, host, suffix = (none if c is None else c for c in (declared, host, suffix))
    declared = F.lower(F.substring(declared, 1, 2))
    given = rows.select("*", text.alias("__text"), declared.alias("__declared"), host.alias("__host"), suffix.alias("__suffix"))
    model = spark.sparkContext.broadcast(train(given.select(F.col("__text").alias("text"), F.col("__declared").alias("declared"))))
    scored = given.withColumn("__ll", text_likelihood(F.col("__text"), model)).drop("__text")
    n = len(LANGUAGES)
    likely = [F.col("__ll")[i + 1] / 3 for i in range(n)]
    top = F.greatest(*likely)
    by_text = F.coalesce(*[F.when(x == top, F.lit(i)) for i, x in enumerate(likely)])
    # grouped counts by host and suffix; each level smooths the next
    tally = (
        given.select("__host", "__suffix", text_likelihood(F.col("__text"), model).alias("__ll"))
        .where(F.col("__ll")[0] > 0)
        .groupBy(F.col("__host").alias("h"), F.col("__suffix").alias("x"))
        .agg(*[F.sum((by_text == i).cast("long")).alias(f"n{i}") for i in range(n)])
    )
    tally = materialize(tally, "hosts")
    sums = tally.agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in range(n)]).first()
    total = sum(sums[i] or 0 for i in range(n))
    overall = [((sums[i] or 0) + 1.0) / (total + n) for i in range(n)]
    of_suffix = tally.groupBy("x").agg(*[F.sum(f"n{i}").alias(f"s{i}") for i in range(n)])
    s_all = sum((F.col(f"s{i}") for i in range(1, n)), F.col("s0"))
    of_suffix = of_suffix.select(F.col("x").alias("sx"), *[((F.col(f"s{i}") + PRIOR_WEIGHT * overall[i]) / (s_all + PRIOR_WEIGHT)).alias(f"p{i}") for i in range(n)])
    h_all = sum((F.col(f"n{i}") for i in range(1, n)), F.col("n0"))
    priors = tally.join(of_suffix, F.col("x").eqNullSafe(F.col("sx"))).select(
        "h", "x", *[F.log((F.col(f"n{i}") + PRIOR_WEIGHT * F.col(f"p{i}")) / (h_all + PRIOR_WEIGHT)).alias(f"q{i}") for i in range(n)]
    )
    priors = materialize(priors, "priors")
    joined = scored.join(priors, F.col("__host").eqNullSafe(F.col("h")) & F.col("__suffix").eqNullSafe(F.col("x")), "left")
    wrong_declared, wrong_suffix = (1 - DECLARED_RIGHT) / (n - 1), (1 - SUFFIX_RIGHT) / (n - 1)
    stands_for = F.create_map(*[F.lit(v) for kv in SUFFIXES.items() for v in kv])
    implied = F.when(F.col("__suffix").isNotNull(), F.try_element_at(stands_for, F.col("__suffix")))
    logs = []
    for i, lang in enumerate(LANGUAGES):
        said = F.when(F.col("__declared").isin(*LANGUAGES), F.when(F.col("__declared") == lang, float(np.log(DECLARED_RIGHT))).otherwise(float(np.log(wrong_declared)))).otherwise(0.0)
        tld = F.when(implied.isNotNull(), F.when(implied == lang, float(np.log(SUFFIX_RIGHT))).otherwise(float(np.log(wrong_suffix)))).otherwise(0.0)
        logs.append(likely[i] + said + tld + F.coalesce(F.col(f"q{i}"), F.lit(float(np.log(overall[i])))))
    logs = [x + float(np.log(1 - OTHER)) for x in logs]
    logs.append(F.col("__ll")[n + 1] / 3 + float(np.log(OTHER)))
    joined = joined.select(*[F.col(c) for c in scored.columns if not c.startswith("__")], (F.col("__ll")[0] > 0).alias("__any"), F.array(*logs).alias("__logs"))
    best = F.array_max("__logs")
    name = F.element_at(F.array(*[F.lit(x) for x in (*LANGUAGES, "und")]), F.array_position("__logs", best).cast("int"))
    share = 1 / F.aggregate("__logs", F.lit(0.0), lambda a, x: a + F.exp(x - best))
    lang = F.when(F.col("__any"), name).otherwise(F.lit("und"))
    prob = F.when(F.col("__any") & (lang != "und"), share).otherwise(F.lit(0.0))
    return joined.withColumns({"lang_id": lang, "lang_prob": prob}).withColumn("lang_ok", F.col("lang_id").isin(*accept) & (F.col("lang_prob") >= least)).drop("__any", "__logs")


def identify_documents(docs: DataFrame) -> DataFrame:
    """Columns of ``docs`` as c0, c1, ... plus lang_id, lang_prob, lang_ok; lang is the declared language, source the host."""
    names = docs.columns
    flat = docs.toDF(*[f"c{i}" for i in range(len(names))])
    col = {x: F.col(f"c{names.index(x)}").cast("string") for x in ("text", "lang", "source") if x in names}
    return identify(flat, col["text"], col.get("lang"), col.get("source"))


def op8_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return identify_documents(docs).select(F.col("c0").alias("doc_id"), "lang_id", "lang_prob", "lang_ok")


def pages_language(spark, sf_dir: str) -> DataFrame:
    """Web pages: text of the markup without tags, language attribute, host and suffix of the url."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    bare = F.regexp_replace(F.regexp_replace(F.col("html"), r"(?is)<(script|style)\b.*?</\1>", " "), r"(?s)<!--.*?-->|<[^>]*>", " ")
    declared = F.nullif(F.regexp_extract("html", r"(?i)<html[^>]*\blang=[\"']?([A-Za-z]+)", 1), F.lit(""))
    host = F.lower(F.regexp_extract("url", r"://([^/?#:]*)", 1))
    return identify(pages, bare, declared, host, suffix_of(F.col("url"))).select("page_id", "lang_id", "lang_prob", "lang_ok")
