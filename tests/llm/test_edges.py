"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names, for every operator."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from canopy.llm import pipeline as corpus_pipeline
from canopy.llm import bpe, langid, licenses, lines, lm, media, mixing, near, shared, topk, urls

LONG = "word and another one " * 20_000
TEXTS = [
    (1, "the quick brown fox jumps over the lazy dog near the old river bank", "en", "a"),
    (1, "the quick brown fox jumps over the lazy dog near the old river bank", "en", "a"),
    (2, None, None, None),
    (3, "", "xx", "a"),
    (None, "der schnelle braune Fuchs springt \u00fcber den faulen Hund am alten Fluss", "de", None),
    (5, LONG, "en", "b"),
    (6, "All rights reserved.\n\nAll rights reserved.\n \nCC BY", "en", "b"),
    (7, "\x00\x1f \u00a0\u3000 \U0001f600 e\u0301 <|endoftext|>", "", ""),
]


@pytest.fixture(scope="module")
def docs(spark):
    """With columns whose names clash with each other and with names that operators use inside."""
    df = spark.createDataFrame(TEXTS, "doc_id long, text string, lang string, source string")
    extra = df.withColumn("n_chars", F.length("text").cast("long"))
    return extra.select("*", F.lit("x").alias("words"), F.lit("y").alias("row"), F.lit("z").alias("doc"), F.lit(1).alias("size"), F.lit("q").alias("__text"), F.lit("r").alias("TEXT"), F.lit("k").alias("key"))


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_bpe(docs, empty):
    from tokenizers import Tokenizer

    path = __import__("public_tokenizers").path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    got = sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded) for r in bpe.encode(docs, path).collect())
    want = []
    for i, t, *_ in TEXTS:
        ids = plain.encode(t or "", add_special_tokens=False).ids
        want.append((i or 0, len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(), plain.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want)
    assert bpe.encode(empty, path).count() == 0


def test_licenses(docs, empty):
    got = {(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.scan(docs).collect()}
    assert (6, 8, 3, 0, 6, "cc-by,reserved") in got and (2, 0, 0, None, None, "") in got and (3, 0, 0, None, None, "") in got
    assert licenses.scan(docs).count() == len(TEXTS) and licenses.scan(empty).count() == 0


def test_lines(docs, empty):
    rows = lines.dedup(docs).collect()
    assert len(rows) == len(TEXTS)
    once = sorted((r.n_removed, r.c1) for r in rows if r.c0 == 1)
    assert once == [(0, TEXTS[0][1]), (1, "")]
    assert [(r.c1, r.n_lines) for r in rows if r.c0 == 2] == [(None, 0)]
    assert [r.c1 for r in rows if r.c0 == 6] == [TEXTS[6][1]]  # too few words
    assert lines.dedup(docs, least_words=3).where("c0 = 6").first().c1 == "All rights reserved.\n\n \nCC BY"
    assert lines.dedup(empty).count() == 0


def test_lm(docs, empty):
    got = lm.score(docs).collect()
    model = lm.Automaton([t for i, t, *_ in TEXTS if not lm.held_out(i)])
    assert len(got) == len(TEXTS)
    for r in got:
        assert any((i == r.doc_id and r.n_tokens == len(lm.Automaton.words(t)) + 1 and abs(r.score - model.score(t)) < 1e-6 * max(1, abs(r.score))) for i, t, *_ in TEXTS)
        assert r.train_tokens == model.n and r.held_out == lm.held_out(r.doc_id)
    assert lm.score(empty).count() == 0


def test_media(spark, docs, empty):
    folder = shared.new_path(spark, "test-media")
    rows = media.store(docs, folder)
    read = {r.digest: r for r in media.features(rows.dropDuplicates(["digest"]), folder).collect()}
    heads = {r.digest: r for r in media.headers(rows.dropDuplicates(["digest"]), folder).collect()}
    assert rows.count() == len(TEXTS)
    for i, t, *_ in TEXTS:
        raw = (t or "").encode()
        payload = raw + b" " * (-len(raw) % 192 or (192 if not raw else 0))
        r = read[hashlib.sha256(payload).hexdigest()]
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), r.digest, zlib.crc32(payload[-16:]))
        assert (heads[r.digest].width, heads[r.digest].height) == (192, len(payload) // 192)
    assert media.store(empty, folder).count() == 0


def test_shards_are_tar_files(spark, docs):
    import tarfile

    folder = shared.new_path(spark, "test-tar")
    row = media.store(docs, folder).where("doc_id = 1").first()
    with tarfile.open(f"{folder.removeprefix('file://')}/{row.shard}") as tar:
        member = tar.getmember(f"{row.digest[:2]}/{row.digest}.png")
        assert (member.offset_data, member.size) == (row.offset, row.length)
        assert media.from_png(tar.extractfile(member).read()).rstrip() == TEXTS[0][1].encode()


def test_damaged_image_is_noticed():
    good = bytearray(media.to_png(b"x" * 192))
    good[60] ^= 1
    with pytest.raises(Exception):
        media.from_png(bytes(good))


def test_mixing(docs, empty):
    rows = mixing.mix(docs, [1, 2, 3]).collect()
    assert len(rows) == len(TEXTS)
    assert all(r.taken == r.copies * r["size"] and 0 <= r.copies <= 3 for r in rows)
    sources = {(r.source_size, r.target) for r in rows}
    assert abs(sum(t for _, t in sources) - sum(n for n, _ in sources)) < 1e-6 and all(t <= 3 * n + 1e-9 for n, t in sources)
    assert rows and sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix(docs, [1, 2, 3]).collect()), key=str)
    assert mixing.mix(empty, [1, 2, 3]).count() == 0


def test_urls(spark):
    rows = [(1, None), (2, "no scheme"), (3, "HTTP://WWW.Example.com:80/a/?q#f"), (4, "http://example.com/a"), (5, ""), (6, "x://a.com/en/q"), (6, "x://a.com/en/q"), (7, "s://com"), (8, "s://u@xcom/en/"), (9, "a\nb://Host/p\nq?x")]
    pages = spark.createDataFrame(rows, "page_id long, url string").select("*", F.lit(1).alias("host"), F.lit(1).alias("URL"))
    listed = spark.createDataFrame([("https://example.com/a/",), (None,)], "url string")
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict, r.listed) for r in urls.judge(pages, listed, urls.RULES).collect())
    assert got == [
        (1, "", "", None, "allow", False), (2, "", "", None, "allow", False), (3, "www.example.com:80", "/a/", None, "block", True), (4, "example.com", "/a", None, "block", True), (5, "", "", None, "allow", False),
        (6, "a.com", "/en/q", "com/en/", "block", False), (6, "a.com", "/en/q", "com/en/", "block", False), (7, "com", "", None, "allow", False), (8, "u@xcom", "/en/", None, "allow", False), (9, "host", "/p\nq", None, "allow", False),
    ]
    assert urls.judge(pages.limit(0), listed.limit(0), urls.RULES).count() == 0


def test_longest_rule_wins(spark):
    pages = spark.createDataFrame([(1, "s://a.example.com/en/71"), (2, "s://example.com/en/8"), (3, "s://example.net/de/8x"), (4, "s://q.net/de/")], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge(pages, pages.limit(0), urls.RULES).collect()}
    assert got == {1: ("example.com/en/7", "allow"), 2: ("com/en/", "block"), 3: ("example.net/de/8", "block"), 4: ("net/de/", "block")}


def test_bloom_has_no_false_negatives(spark):
    hashes = spark.range(20_000).select(F.xxhash64("id").alias("h1"), F.xxhash64(F.lit(1), "id").alias("h2"))
    bits = urls.bloom(hashes, 20_000)
    rows = hashes.toPandas()
    block, bit = urls._places(rows.h1.to_numpy(), rows.h2.to_numpy(), len(bits) // urls.BLOCK)
    at = block[:, None] * urls.BLOCK * 8 + bit
    assert ((bits[at >> 3] >> (at & 7).astype("uint8")) & 1).all()


def test_language(docs, empty):
    rows = langid.identify_documents(docs).collect()
    assert len(rows) == len(TEXTS)
    by = {r.c1: r for r in rows}
    assert by[TEXTS[0][1]].lang_id == "en" and by[TEXTS[4][1]].lang_id == "de"
    assert by[None].lang_id == by[""].lang_id == "und" and not by[None].lang_ok
    assert langid.identify_documents(empty).count() == 0


def test_topk(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [-1.0, 0.0]), (50, [0.5, 0.25]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (100, [1.0]), (None, [3.0, 3.0]), (150, None), (200, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").select("*", F.lit(1).alias("row"), F.lit("x").alias("id"), F.lit(0).alias("VEC"))
    got = [tuple(r) for r in topk.search(df, F.coalesce(F.col("id") % 50 == 0, F.lit(False)), 3).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, None, 3 * 256 * 256 + 6 * 256 * 256), (0, 2, 1, 5 * 65536), (0, 3, 1, 5 * 65536), (50, 1, None, 128 * 768 + 64 * 768), (50, 2, 0, 65536), (50, 3, 1, 65536)]
    assert topk.search(df.limit(0), F.col("id") % 50 == 0, 3).count() == 0


def test_topk_big_components_are_exact(spark):
    df = spark.createDataFrame([(0, [1048577.0, 3.0]), (1, [1048575.0, 1.0]), (2, [1048576.0, -5.0])], "vec_id long, embedding array<float>")
    got = {(r.query_id, r.vec_id): r.score for r in topk.search(df, F.col("id") % 50 == 0, 5).collect()}
    assert got == {(0, 1): 1048577 * 256 * 1048575 * 256 + 768 * 256, (0, 2): 1048577 * 256 * 1048576 * 256 - 768 * 5 * 256}


def test_near(docs, empty):
    rows = [(r.doc_id, r.class_size) for r in near.classes(docs).collect()]
    assert len(rows) == len(TEXTS) and rows.count((1, 2)) == 2 and (2, 2) in rows and (3, 2) in rows and (5, 1) in rows
    assert near.classes(empty).count() == 0
    kept = near.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(TEXTS) - 2
    assert near.keep_one(empty).count() == 0


@pytest.mark.parametrize("nothing", [False, True])
def test_pipeline(spark, docs, empty, nothing):
    now = empty if nothing else docs
    for name, stage in corpus_pipeline.STAGES:
        out = shared.materialize(stage(spark, now, ""), "test") if name == "BPE" else stage(spark, now, "")
        if name != "BPE":
            assert out.columns == docs.columns
            path = shared.new_path(spark, "test-stage")
            out.toDF(*[f"c{i}" for i in range(len(out.columns))]).write.parquet(path)
            now = spark.read.parquet(path).toDF(*docs.columns)
        else:
            assert (out.count() == 0) == nothing
