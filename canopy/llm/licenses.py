"""License scans by a positional rare-token index.

Templates are licence notices, each with mandatory key phrases. The index holds postings: for each word of the key
phrases, the templates and the positions in them that the word stands for. Which words these are is settled by IDF, from
document frequencies over the whole corpus (a count for each word of the key phrases, so a table of fixed size): of each
template the ``RARE`` words of highest IDF. A text must have them all to hold the template, so they are the words of
highest IDF that it shares with it. A text's own licence words are looked up in the index; each occurrence proposes the
templates of its postings and the places where they would start; the proposals of a template's several words are
intersected by place, and a place stands if all key phrases are there word by word at their positions. The score is the
largest share of a found template's words that the text has at their positions (0 without any).

The templates are data in the plan: a text costs as much as it has words and hits, however many templates there are.

Words are runs of characters other than U+0000-2F, 3A-60 and 7B-7F, after A-Z are lower-cased. Everything happens within
a row by array functions: no shuffle, so neither frequent lines nor copies gather anywhere. Null and empty texts have no
words, empty labels and score 0. Repeated rows repeat; very long texts are taken whole; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.llm.shared import ascii_lower, pick

#: Phrases whose places are counted, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Labels of the method: label, notice, and the key phrases that must stand in it. Wording of public licences.
TEMPLATES = [
    ("agpl-3.0", "gnu affero general public license version 3", ["affero general public license", "version 3"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license", "version 2 0"]),
    (
        "apache-2.0",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
        ["unless required by applicable law or agreed to in writing", "on an as is basis"],
    ),
    ("artistic-2.0", "released under the artistic license 2 0", ["artistic license 2 0"]),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        ["redistribution and use in source and binary forms", "with or without modification"],
    ),
    ("bsl-1.0", "distributed under the boost software license version 1 0", ["boost software license"]),
    ("cc-by-nc", "licensed under cc by nc", ["cc by nc"]),
    ("cc-by-nd", "licensed under cc by nd", ["cc by nd"]),
    ("cc-by-sa", "licensed under cc by sa", ["cc by sa"]),
    ("cc-by-sa", "licensed under the creative commons attribution sharealike license", ["creative commons attribution sharealike"]),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights", ["waived all copyright and related or neighboring rights"]),
    ("cddl", "subject to the terms of the common development and distribution license", ["common development and distribution license"]),
    ("epl", "made available under the terms of the eclipse public license", ["eclipse public license"]),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ["gnu general public license", "version 2"]),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ["gnu general public license", "version 3"]),
    (
        "gpl-notice",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version",
        ["free software you can redistribute it and or modify it", "gnu general public license"],
    ),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["permission to use copy modify and or distribute this software for any purpose"]),
    ("lgpl", "gnu lesser general public license", ["lesser general public license"]),
    ("mit", "released under the mit license", ["mit license"]),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction",
        ["permission is hereby granted free of charge"],
    ),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("public-domain", "this work is dedicated to the public domain", ["dedicated to the public domain"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software released into the public domain"]),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", ["in no event will the authors be held liable"]),
]
#: So many of the rarest words of a template's key phrases are looked up and intersected.
RARE = 2
#: Start of a template in a text and its number as one integer.
SPAN = 1 << 40
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    plain = F.trim(F.regexp_replace(ascii_lower(text), NOT_WORD, " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def _entries() -> list[tuple[str, list[str], list[tuple[int, list[str]]]]]:
    """Label, words, and key phrases with their offsets; those of BASE first."""
    every = [(label, phrase, [phrase]) for phrase, label in BASE.items()] + TEMPLATES
    return [(label, t.split(), [(_offset(t.split(), k.split()), k.split()) for k in keys]) for label, t, keys in every]


def _offset(template: list[str], phrase: list[str]) -> int:
    return next(i for i in range(len(template)) if template[i : i + len(phrase)] == phrase)


def document_frequencies(words: DataFrame) -> dict[str, int]:
    """Of the words of all key phrases, over ``words(words)``."""
    vocabulary = sorted({w for _, _, keys in _entries() for _, k in keys for w in k})
    own = F.array_intersect("words", F.lit(vocabulary))
    counted = words.select(F.explode(own).alias("w")).groupBy("w").count().collect()  # a row a word of the key phrases
    return dict.fromkeys(vocabulary, 0) | {r["w"]: r["count"] for r in counted}


def rarest(frequency: dict[str, int]) -> list[list[tuple[str, int]]]:
    """For each template its words of highest IDF (word, position), one for each of RARE slots."""
    out = []
    for _, _, keys in _entries():
        at = {w: offset + i for offset, k in keys for i, w in reversed(list(enumerate(k)))}
        by = sorted(at, key=lambda w: (frequency[w], at[w]))
        out.append([(by[min(slot, len(by) - 1)], at[by[min(slot, len(by) - 1)]]) for slot in range(RARE)])
    return out


def places(words: Column, frequency: dict[str, int]) -> Column:
    """array<struct<t, start>>: the templates found in ``words``, by number, and where each would start (perhaps before the first word)."""
    chosen = rarest(frequency)
    vocabulary = sorted({w for slots in chosen for w, _ in slots})

    def postings(slot: int) -> Column:
        """By word of the vocabulary: template * SPAN - position, for the templates whose word it is in this slot."""
        of = [[t * SPAN - at for t, slots in enumerate(chosen) for w, at in [slots[slot]] if w == v] for v in vocabulary]
        return F.array(*[F.array(*[F.lit(x) for x in p]).cast("array<bigint>") for p in of])

    word = F.lit(vocabulary)
    hits = F.array_compact(F.transform(words, lambda w, i: F.when(w.isin(*vocabulary), F.struct(i.alias("i"), (F.array_position(word, w) - 1).cast("int").alias("w")))))

    def proposed(slot: int) -> Column:
        of = postings(slot)
        return F.flatten(F.transform(hits, lambda h: F.transform(F.get(of, h["w"]), lambda x: x + h["i"])))

    common = reduce(F.array_intersect, [proposed(slot) for slot in range(RARE)])
    number = lambda x: F.floor((x + SPAN // 2) / SPAN).cast("int")
    found = F.transform(common, lambda x: F.struct(number(x).alias("t"), (x - number(x).cast("long") * SPAN).cast("int").alias("start")))
    keys = F.array(*[F.array(*[F.struct(F.lit(at).alias("at"), F.lit(k).alias("k")) for at, k in keys]) for _, _, keys in _entries()])
    there = lambda f, k: (f["start"] + k["at"] >= 0) & (F.slice(words, F.greatest(f["start"] + k["at"], F.lit(0)) + 1, F.size(k["k"])) == k["k"])
    return F.filter(found, lambda f: F.forall(F.get(keys, f["t"]), lambda k: there(f, k)))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, for each row of ``docs``."""
    rows = pick(docs, id=id_col, text=text_col).select(F.col("id").alias("doc_id"), words_of(F.col("text")).alias("words"))
    frequency = document_frequencies(rows.select("words"))
    found = rows.select("doc_id", "words", places(F.col("words"), frequency).alias("found"))
    base = F.transform(F.filter("found", lambda f: f["t"] < len(BASE)), lambda f: f["start"])
    names, texts = F.lit([label for label, _, _ in _entries()]), F.array(*[F.lit(t) for _, t, _ in _entries()])
    labels = lambda some: F.array_join(F.array_sort(F.array_distinct(F.transform(some, lambda f: F.get(names, f["t"])))), ",")

    def share(f: Column) -> Column:
        text = F.get(texts, f["t"])
        same = F.filter(text, lambda w, i: (f["start"] + i >= 0) & (F.get("words", F.greatest(f["start"] + i, F.lit(0))) == w))
        return F.size(same) / F.size(text)

    return found.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.size(base).cast("long").alias("n_base"),
        F.array_min(base).cast("long").alias("first_word"),
        F.array_max(base).cast("long").alias("last_word"),
        labels(F.filter("found", lambda f: f["t"] < len(BASE))).alias("base_labels"),
        labels(F.col("found")).alias("labels"),
        F.coalesce(F.array_max(F.transform("found", share)), F.lit(0.0)).alias("score"),
    )


def op1_licenses(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    """The same result from DuckDB, trying every place of every template."""
    cols, scores, labels, base_labels, base = [], [], [], [], []
    for n, (label, t, keys) in enumerate(_entries()):
        at = [(offset + i, w) for offset, k in keys for i, w in enumerate(k)]
        low = min(i for i, _ in at)
        tests = " AND ".join(f"w[s + {i + 1}] = '{x}'" for i, x in at)
        cols.append(f"list_filter(range(-{low}, len(w)), lambda s: {tests}) AS p{n}")
        total = " + ".join(f"(CASE WHEN s + {i} >= 0 AND w[s + {i + 1}] = '{x}' THEN 1 ELSE 0 END)" for i, x in enumerate(t))
        scores.append(f"coalesce(list_max(list_transform(p{n}, lambda s: ({total}) / {float(len(t))})), 0.0)")
        labels.append(f"CASE WHEN len(p{n}) > 0 THEN '{label}' END")
        if n < len(BASE):
            base_labels.append(labels[-1])
            base.append(f"p{n}")
    joined = lambda x: f"coalesce(array_to_string(list_sort(list_distinct(list_filter([{', '.join(x)}], lambda l: l IS NOT NULL))), ','), '')"
    every = f"flatten([{', '.join(base)}])"
    return f"""
WITH d AS (
  SELECT doc_id, trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g')) AS t FROM documents
), w AS (
  SELECT doc_id, CASE WHEN t = '' THEN CAST([] AS VARCHAR[]) ELSE string_split(t, ' ') END AS w FROM d
), p AS (
  SELECT doc_id, w, {', '.join(cols)} FROM w
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len({every}) AS BIGINT) AS n_base,
  list_min({every}) AS first_word, list_max({every}) AS last_word,
  {joined(base_labels)} AS base_labels, {joined(labels)} AS labels,
  CAST(greatest({', '.join(scores)}) AS DOUBLE) AS score
FROM p
"""


OP1_SQL = _sql()
