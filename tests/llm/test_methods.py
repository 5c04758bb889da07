"""Each method against brute force or exact properties, on the small tables."""

import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from canopy.llm import pipeline as corpus_pipeline
from canopy.llm import bpe, langid, lines, lm, mixing, near, registry, topk
from compare import oracle, same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_oracle(spark, name):
    same(registry.queries()[name](spark, SF).toPandas(), oracle(registry.oracle_sql()[name], SF))


def test_bpe_equals_the_library_on_odd_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain, ours = Tokenizer.from_file(path), bpe.Encoder(path)
    rnd = random.Random(5)
    letters = "abcXYZ don't 's 'll 're 123 \u0663 \u00e9\u00c9 e\u0301 ***'s ,.<|endoftext|> <|startoftext|>< |   \t\n\x0b\x1c\x85 \u0130 \u0391\u03a3 \u00df \u4f60\u597d \U0001f600 \u200d $%& '' -- _ \x00 \ufb01 \u00bd \u2167"
    for _ in range(3000):
        text = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 25)))
        raw, decoded = ours.encode(text)
        ids = plain.encode(text, add_special_tokens=False).ids
        assert [int.from_bytes(raw[j : j + 4], "little") for j in range(0, len(raw), 4)] == ids, repr(text)
        assert decoded == plain.decode(ids, skip_special_tokens=False)


def test_lm_equals_the_automaton_and_beats_its_base(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    model = lm.Automaton([t for i, t in texts if not lm.held_out(i)])
    got = {r.doc_id: r for r in lm.score(docs).collect()}
    for i, t in texts:
        words = [*model.words(t), model.STOP]
        base = sum(math.log10(model.p0(w)) for w in words)
        assert math.isclose(got[i].base_score, base, rel_tol=1e-9) and math.isclose(got[i].score, model.score(t), rel_tol=1e-9)
        assert got[i].n_known == sum(model.c[w] > 0 for w in words)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_lm_probabilities_sum_to_one():
    model = lm.Automaton(["a b a c", "a b", "c"])
    for state in [*model.arcs, model.ROOT]:
        total = sum(10 ** model.step(state, w)[1] for w in model.c) + 10 ** model.step(state, b"unseen")[1]
        assert math.isclose(total, 1.0, rel_tol=1e-9)


def test_mixing_targets_and_nearness(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 37)), f"s{i % 7}") for i in range(4000)] + [(9000 + i, "x " * 5, "tiny") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs, [1, 2, 3]).collect()
    words, goal, taken, count = Counter(), {}, Counter(), Counter()
    for r in got:
        source = "tiny" if r.doc_id >= 9000 else f"s{r.doc_id % 7}"
        words[source] += r["size"]
        goal[source], taken[source] = r.target, taken[source] + r.taken
        count[r.copies] += 1
    assert math.isclose(sum(goal.values()), sum(words.values()))
    assert goal["tiny"] == 3 * words["tiny"] == taken["tiny"]
    for s in goal:
        assert abs(taken[s] - goal[s]) <= 37 and goal[s] <= 3 * words[s] + 1e-6
    weight = {s: [1, 2, 3][i % 3] for i, s in enumerate(sorted(goal))}
    free = {goal[s] / weight[s] for s in goal if s != "tiny"}
    assert max(free) - min(free) < 1e-6


def brute_classes(texts):
    sets = {i: Counter(zip(*[t.lower().split()[j:] for j in range(5)], strict=False)) if len(t.split()) >= 5 else Counter([tuple(t.lower().split())]) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    holds = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            holds[x].add(i)
    pairs = {p for ids in holds.values() for p in itertools.combinations(sorted(ids), 2)}
    for a, b in pairs:
        both = sum((sets[a] & sets[b]).values())
        if both >= 0.8 * (sum(sets[a].values()) + sum(sets[b].values()) - both):
            parent[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in texts}


def planted(seed=3, groups=25, copies=12):
    """Texts with word changes of growing number; in each group also chains of changes."""
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(4000)]
    texts, n = {}, 0
    for _ in range(groups):
        base = rnd.choices(vocabulary, k=rnd.randint(60, 200))
        shared = rnd.choices(vocabulary, k=40)
        for c in range(copies):
            words = list(texts[n - 1].split()) if c % 4 == 3 and n else list(base)
            for _ in range(rnd.randint(0, 6)):
                words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
            texts[n] = " ".join(words)
            n += 1
        for _ in range(3):
            texts[n] = " ".join(shared + rnd.choices(vocabulary, k=60))
            n += 1
    return texts


def test_near_equals_all_pairs(spark):
    texts = planted()
    got = {r.doc_id: r.class_id for r in near.classes(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    want = brute_classes(texts)
    wrong = [i for i in texts if got[i] != want[i]]
    assert not wrong, wrong


def test_similarity_follows_order():
    a = np.arange(100, dtype=np.uint64)
    assert near.similarity(a, a) == 1.0
    assert near.similarity(a, np.concatenate((a[50:], a[:50]))) == 0.0
    assert math.isclose(near.similarity(a, a[5:]), 0.95)
    assert near.similarity(a, a[:70]) == 0.0


def test_sketches_agree_as_often_as_expected():
    rnd = random.Random(1)
    agree = total = 0
    for _ in range(40):
        words = [f"t{rnd.randrange(10**9)}" for _ in range(300)]
        other = list(words)
        for i in range(4, 300, 48):
            other[i] = "changed"
        labelled, number = near.shingles([" ".join(words), " ".join(other)])
        s = near.sketches(labelled, number)
        agree, total = agree + (s[0] == s[1]).sum(), total + near.SKETCHES
    assert 0.4 < agree / total < 0.65


def test_topk_with_many_query_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = topk.search(df, F.col("id") % 50 == 0, 5).toPandas()
    same(got, oracle(topk.OP9_SQL, SF))


def test_language_on_rows_it_was_not_trained_on(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source")
    hidden = docs.withColumn("lang", F.when(F.col("doc_id") % 3 != 0, F.col("lang")))
    out = langid.identify_documents(hidden).select(F.col("c0").alias("doc_id"), "lang_id", "lang_ok")
    held = out.join(docs, "doc_id").where("doc_id % 3 = 0")
    assert held.where("lang_id = lang AND lang_ok").count() >= 0.98 * held.count()


def test_priors_help_short_texts(spark):
    rows = [(f"the house is near the river and the town {i}", "en", "h1") for i in range(30)] + [(f"das haus ist nahe dem fluss und der stadt {i}", "de", "h2") for i in range(30)] + [("in ort", None, "h1"), ("in ort", None, "h2")]
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    got = {r.c2: r.lang_prob if r.lang_id == "en" else 1 - r.lang_prob for r in langid.identify_documents(df).where("c0 = 'in ort'").collect()}
    assert got["h1"] > got["h2"]


def test_pipeline_stages_do_what_they_say(spark):
    text = lambda s, n: " ".join(f"the word{(s * 7919 + k * 31) % 5003} and" for k in range(n))
    line = "this very line stands in many of the documents of this corpus again"
    rows = [(i, text(i, 40) + f"\n{line}", "en", f"s{i % 3}") for i in range(40)]
    rows += [(100, text(1, 39) + " changed\n" + line, "en", "s0"), (101, None, "en", "s1"), (102, "12345 67890", "en", "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["language ID"](spark, docs, "")
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in rows} - {101, 102}
    lined = stages["line dedup"](spark, kept, "")
    assert sorted(r.doc_id for r in lined.collect() if line in r.text) == [0]
    single = stages["near dedup"](spark, lined, "")
    assert {r.doc_id for r in single.collect()} == set(range(40))
    mixed = stages["mixing"](spark, single, "")
    counts = Counter(r.doc_id for r in mixed.collect())
    assert set(counts) <= set(range(40)) and max(counts.values()) <= 3
    assert stages["BPE"](spark, mixed, "").count() == sum(counts.values())


def test_pages_have_the_language_of_their_paths(spark):
    got = langid.pages_language(spark, SF)
    paths = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", F.regexp_extract("url", "://[^/]*/(..)/", 1).alias("said"))
    both = got.join(paths, "page_id")
    assert both.where("said = lang_id").count() >= 0.95 * both.count()


def test_pages_are_judged_by_markup_suffix_and_host(spark):
    rows = [("the house is near the river and the town", "en", "h.uk", "uk")] * 5 + [("das haus ist nahe dem fluss und der stadt", "de", "h.de", "de")] * 5 + [("in", None, "h.uk", "uk"), ("in", None, "h.de", "de")]
    df = spark.createDataFrame(rows, "text string, said string, host string, suffix string")
    out = langid.identify(df, F.col("text"), F.col("said"), F.col("host"), F.col("suffix")).where("text = 'in'").collect()
    assert {r.lang_id for r in out} == {"und"}  # two letters hold no trigram
    longer = df.withColumn("text", F.concat("text", F.lit(" zqx")))
    out = langid.identify(longer, F.col("text"), F.col("said"), F.col("host"), F.col("suffix")).where("text = 'in zqx'").collect()
    assert {(r.host, r.lang_id) for r in out} == {("h.uk", "en"), ("h.de", "de")}


def test_suffix(spark):
    urls = ["https://a.b.DE/x.fr", "http://h.co.uk:80/", "ftp://localhost/a.es", "x.fr", None, "https://a.es?q=.de"]
    df = spark.createDataFrame([(u,) for u in urls], "u string").select(langid.suffix_of(F.col("u")).alias("s"))
    assert [r.s for r in df.collect()] == ["de", "uk", None, "fr", None, "es"]
