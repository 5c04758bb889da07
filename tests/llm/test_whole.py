"""What the operators left out once: cases that each of them has to do whole."""

import hashlib
import random
import re
from collections import defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from canopy.llm import bpe, langid, licenses, lines, lm, media, mixing, near, pipeline, shared, topk


SF = "/root/testdata/sf0.01"


def brute_runs(rows, least):
    """Every place against all earlier ones: the common run of lines goes at the later place if it has enough words."""
    at, gone = [], defaultdict(set)
    for i, t in sorted(rows):
        s = [(n, x) for n, x in enumerate(t.split("\n")) if x.strip(" \t\r")]
        at += [(i, s, k) for k in range(len(s))]
    for later, (i, s, k) in enumerate(at):
        for _, t, m in at[:later]:
            common = 0
            while k + common < len(s) and m + common < len(t) and s[k + common][1] == t[m + common][1]:
                common += 1
            if sum(x.count(" ") + 1 for _, x in s[k : k + common]) >= least:
                gone[i] |= {n for n, _ in s[k : k + common]}
    return {i: sorted(gone[i]) for i, _ in rows}


@pytest.mark.parametrize("least", [1, 4, 10])
def test_whole_runs_equal_brute_force(spark, least):
    rnd = random.Random(least)
    pool = ["a", "b b", "c c c", "d d d d", "e e e e e e e e e e e", "", " "]
    rows = [(i, "\n".join(rnd.choice(pool) for _ in range(rnd.randint(1, 12)))) for i in range(60)]
    out = lines.dedup(spark.createDataFrame(rows, "doc_id long, text string"), least_words=least).collect()
    assert {r.c0: list(r.removed) for r in out} == brute_runs(rows, least)


def test_pipeline_deletes_the_short_last_lines_of_a_run(spark):
    run = " ".join(f"w{i}" for i in range(40)) + "\nshort line"
    docs = spark.createDataFrame([(1, f"one\n{run}\nmore"), (2, f"two\n{run}\nelse"), (3, run)], "doc_id long, text string")
    out = pipeline.line_dedup(spark, docs, "").collect()
    assert {r.doc_id: r.text for r in out} == {1: f"one\n{run}\nmore", 2: "two\nelse", 3: ""}


def test_lines_after_the_last_window_of_a_run_go(spark):
    run = "a b c d e f g h i j\nb x\nc y"
    docs = spark.createDataFrame([("p", f"{run}\none end"), ("q", f"{run}\nother end")], "doc_id string, text string")
    assert {r.c0: list(r.removed) for r in lines.dedup(docs).collect()} == {"p": [], "q": [0, 1, 2]}


def test_hot_lines_and_windows_are_whole(spark):
    """A line in every text and a run in a third of them, so that both are joined by broadcast."""
    run = "one two three four five\nsix seven eight nine ten"
    rows = [(i, f"common line\n{run if i % 3 == 0 else 'x'}\nown {i}") for i in range(300)]
    out = {r.c0: list(r.removed) for r in lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {i: [0, 1, 2] if i % 3 == 0 and i else [] for i in range(300)}


def test_pipeline_leaves_no_tables_but_those_still_read(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    before = shared.written(spark)
    for n, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, "").write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        assert docs.count() > 0
    assert shared.written(spark) <= before  # the last stage writes none


def test_other_languages_and_junk_are_rejected(spark):
    rnd = random.Random(2)
    junk = " ".join("".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(3, 9))) for _ in range(40))
    other = [
        "la casa si trova vicino al fiume e la citt\u00e0 \u00e8 molto bella quando il sole scende dietro le montagne e gli uccelli cantano",
        "\u0434\u043e\u043c \u0441\u0442\u043e\u0438\u0442 \u0440\u044f\u0434\u043e\u043c \u0441 \u0440\u0435\u043a\u043e\u0439 \u0438 \u0433\u043e\u0440\u043e\u0434 \u043e\u0447\u0435\u043d\u044c \u043a\u0440\u0430\u0441\u0438\u0432\u044b\u0439 \u043a\u043e\u0433\u0434\u0430 \u0441\u043e\u043b\u043d\u0446\u0435 \u0441\u0430\u0434\u0438\u0442\u0441\u044f",
        "\u623f\u5b50\u5728\u6cb3\u8fb9\u57ce\u5e02\u5f88\u7f8e\u4e3d\u592a\u9633\u4e0b\u5c71\u7684\u65f6\u5019\u9e1f\u513f\u5728\u5531\u6b4c",
        junk,
    ]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("text", "lang", "source")
    more = spark.createDataFrame([(t, None, None) for t in other], "text string, lang string, source string")
    out = langid.identify_documents(docs.unionByName(more))
    assert {(r.lang_id, r.lang_ok) for r in out.where(out.c0.isin(other)).collect()} == {("und", False)}
    known = out.where("c1 IS NOT NULL")
    assert known.where("lang_ok AND lang_id = c1").count() == known.count() == docs.count()


def test_bpe_special_tokens_in_any_case():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain, ours = Tokenizer.from_file(path), bpe.Encoder(path)
    rnd = random.Random(7)
    some = ["<|endoftext|>", "<|ENDOFTEXT|>", "a<|EndOfText|>b", "<|StartOfText|>", "<|STARTOFTEXT|>", "<|", "|>", "Word", "X<|Y", "\u00c9", " ", "9"]
    for text in [*some, *("".join(rnd.choices(some, k=rnd.randint(1, 6))) for _ in range(1000))]:
        raw, decoded = ours.encode(text)
        ids = plain.encode(text, add_special_tokens=False).ids
        assert [int.from_bytes(raw[j : j + 4], "little") for j in range(0, len(raw), 4)] == ids, repr(text)
        assert decoded == plain.decode(ids, skip_special_tokens=False)


def test_pipeline_returns_ids_and_decoded_text(spark):
    docs = spark.createDataFrame([(1, "two words"), (2, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in pipeline.encode(spark, docs, "").collect()}
    assert rows[1].decoded == "two</w> words</w>" and rows[2].decoded == ""
    for r in rows.values():
        assert len(r.ids) == 4 * r.n_tokens and hashlib.sha256(r.ids).hexdigest() == r.ids_sha256
        assert hashlib.sha256(r.decoded.encode()).hexdigest() == r.decoded_sha256


def test_near_finds_short_texts_that_agree_in_no_sketch(spark):
    def missed():
        """Texts of nine and of eight words, at 0.8, without a common sketch."""
        for start in range(0, 100_000, 1000):
            long = [" ".join(f"w{start + i}x{j}" for j in range(9)) for i in range(1000)]
            short = [t.rpartition(" ")[0] for t in long]
            a, b = (near.sketches(*near.shingles(texts)) for texts in (long, short))
            for i in (~(a == b).any(axis=1)).nonzero()[0]:
                return long[i], short[i]

    pair = missed()
    assert near.similarity(*(near.shingles([t])[0] for t in pair)) >= near.SIMILAR - 1e-9
    docs = spark.createDataFrame([(1, pair[0]), (2, pair[1]), (3, "other words stand here alone"), (4, "")], "doc_id long, text string")
    assert {r.doc_id: (r.class_id, r.class_size) for r in near.classes(docs).collect()} == {1: (1, 2), 2: (1, 2), 3: (3, 1), 4: (4, 1)}


def test_bpe_cuts_inside_words():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain, ours = Tokenizer.from_file(path), bpe.Encoder(path)
    letters = "abcdefghijklmnopqrstuvwxyz"
    never = [a + b for a in letters for b in letters if a + b not in ours.joined]
    assert never
    for pair in never:
        word = f"the{pair}ing"
        assert len(ours.split(word)) > 1
        raw, _ = ours.encode(word)
        ids = plain.encode(word, add_special_tokens=False).ids
        assert [int.from_bytes(raw[j : j + 4], "little") for j in range(0, len(raw), 4)] == ids, word


def test_bpe_cache_is_bounded_by_bytes():
    import public_tokenizers

    coder = bpe.Encoder(public_tokenizers.path("word_bpe_49k.json"), most=20_000)
    long = "x" * 5000
    for i in range(200):
        raw, _ = coder.encode(f"{long} w{i} v{i}")
        assert raw[-4:] and long not in coder.known and coder.held <= 20_000 + 2000


def test_lm_over_many_blocks_and_lanes(spark, monkeypatch):
    monkeypatch.setattr(lm, "SHARD_CHARS", 400)
    rnd = random.Random(4)
    texts = [(i, " ".join(rnd.choice("a b c d e f g".split()) for _ in range(rnd.randint(0, 600)))) for i in range(60)] + [(100, None)]
    model = lm.Automaton([t for i, t in texts if not lm.held_out(i)])
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.score for r in lm.score(docs).collect()}
    assert all(abs(got[i] - model.score(t)) <= 1e-9 * max(1.0, abs(got[i])) for i, t in texts)


def test_lm_counts_beyond_four_bytes():
    import numpy as np

    x = np.array([0, 1, 2**32, 2**40 + 7])
    assert (lm._large(lm._small(x)) == x).all() and (lm._large(lm._small(x[:2])) == x[:2]).all() and len(lm._large(lm._small(x[:0]))) == 0


def brute_licences(text):
    """Every template at every place."""
    import re

    lowered = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", lowered)
    labels, score = set(), 0.0
    for label, template, keys in licenses._entries():
        for s in range(-len(template), len(words)):
            if all(s + at >= 0 and words[s + at : s + at + len(k)] == k for at, k in keys):
                labels.add(label)
                score = max(score, sum(0 <= s + i < len(words) and words[s + i] == w for i, w in enumerate(template)) / len(template))
    return ",".join(sorted(labels)), score


def test_licences_equal_brute_force(spark):
    rnd = random.Random(9)
    notices = [" ".join(t) for _, t, _ in licenses._entries()]
    rows = [(0, None), (1, ""), (2, "general public license")]
    for i in range(3, 150):
        parts = [" ".join(rnd.choices("the license public version 2 3 gnu by cc rights software".split(), k=rnd.randint(0, 8)))]
        for _ in range(rnd.randint(0, 3)):
            words = rnd.choice(notices).split()
            for _ in range(rnd.choice([0, 0, 1, 3])):
                words[rnd.randrange(len(words))] = rnd.choice(["xx", "license", "2"])
            parts.append(rnd.choice([" ", ", ", "\n"]).join(words).upper())
        rows.append((i, " ".join(parts)))
    got = {r.doc_id: (r.labels, round(r.score, 9)) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (a, round(b, 9)) for i, t in rows for a, b in [brute_licences(t)]}



def test_media_query_equals_plain_python(spark):
    import zlib

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = media.op4_media(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        stored = media.to_png(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest())
        assert (r.feature, r.width, r.height) == (media.feature_of(payload), 192, len(payload) // 192)


def test_certain_documents_get_a_copy_more(spark):
    """One source of a large document and many small ones: the large one's chance is 1."""
    rows = [(0, "w " * 3000, "a")] + [(i, "w " * 10, "a") for i in range(1, 101)] + [(i, "w " * 10, "b") for i in range(101, 900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for seed in range(3):
        got = {r.doc_id: r for r in mixing.mix(docs, [7, 17], seed=seed).collect()}
        goal = got[0].target
        assert 3000 < goal < 4000 and got[0].copies == 1 and {r.copies for i, r in got.items() if 0 < i <= 100} == {0, 1}
        assert abs(sum(r.taken for i, r in got.items() if i <= 100) - goal) <= 10


def test_topk_tells_of_components_beyond_64_bits(spark):
    df = spark.createDataFrame([(0, [1e300, 1.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        topk.search(df, F.col("id") % 50 == 0, 5).collect()


def test_ids_that_are_no_integers(spark):
    df = spark.createDataFrame([("a", "same words stand here twice"), ("7", "same words stand here twice")], "doc_id string, text string")
    assert sorted((str(r.doc_id), r.class_size) for r in near.classes(df).collect()) == [("7", 2), ("None", 2)]
    assert {r.doc_id for r in lm.score(df).collect()} == {None, 7}


def test_release_gives_native_memory_back(spark):
    """What the driver's JVM freed in pieces between others returns to the system, so many runs in one driver don't pile up."""
    jvm = spark.sparkContext._jvm
    status = Path(f"/proc/{jvm.java.lang.ProcessHandle.current().pid()}/smaps_rollup")

    def held():
        return int(re.search(r"\nAnonymous:\s+(\d+)", status.read_text())[1]) / 1024

    shared.release(spark)
    memory = jvm.org.apache.spark.unsafe.Platform
    blocks = [memory.allocateMemory(100_000) for _ in range(2000)]
    for block in blocks:
        memory.setMemory(block, 1, 100_000)
    kept = blocks[::50]
    for block in set(blocks) - set(kept):
        memory.freeMemory(block)
    before = held()
    shared.release(spark)
    after = held()
    for block in kept:
        memory.freeMemory(block)
    assert before - after > 120
