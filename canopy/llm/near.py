"""Near-duplicates by Order MinHash.

Words are lower-cased and parted by white space. Shingles are runs of five words (of all words in texts with fewer),
labelled by their occurrence in the text, so that none repeats. For each of ``SKETCHES`` hash functions the sketch
keeps the ``TUPLE`` shingles of least hash, in the order they have in the text; two texts that agree in one sketch are
candidates. Texts at a similarity of 0.8 agree in a sketch with a chance of about 0.51 and in none of 16 with 0.00001;
texts of few shingles agree less often (0.00028 for 4 of 5), so up to ``FEW`` shingles sketches are not relied on.

Candidates are verified by banded alignment: the longest common subsequence c of the two shingle sequences within the
band of offsets that the similarity allows; they are near-duplicates if c / (n1 + n2 - c) is 0.8 or more. Classes are
the connected components of the verified links.

Equal texts (after lower-casing and parting) are one node, so copies are never paired. No bucket is expanded into pairs:

1. Every node of a bucket is verified against one node alone, the bucket's hub: the one that meets most other nodes in
   all its buckets. Verified links give first components. A group of copies of one text meets in that text.
2. Buckets whose nodes then lie in one component are done. For the nodes of the others an exact prefix filter follows:
   under any fixed order of shingles, two texts at 0.8 share one of the first 20 % (and one) of each. The order is by
   frequency among these nodes, rare ones first, as counted in a table of fixed size (collisions change the order, not
   the result); shingles that no other node has are left out, and the place of a shingle bounds the lengths of the
   texts that can meet there. So texts that share a passage or an origin but not enough of it hardly ever meet. Nodes that share such a shingle are verified against a hub again, and what then still lies
   in several components is paired between these.

Nodes of up to ``FEW`` shingles, and those long enough to match one, pass that filter whatever their buckets.

Nulls count as empty texts; all empty texts are one class. Rows with equal ids share nothing but the id. Very long
texts are taken whole. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.llm.shared import as_id, drop_tables, join_counted, materialize, pick, release, small_batches, trim_memory
from canopy.llm.urls import BLOCK, _places, bloom

WORDS, SKETCHES, TUPLE, SIMILAR = 5, 16, 3, 0.8
#: Texts of so many shingles or fewer are compared exactly.
FEW = 30
#: Counters of shingle frequencies are twice the shingles to count, up to this bound; and how many travel together.
MOST_COUNTERS, PIECE = 1 << 24, 1 << 15
MOST = np.uint64(2**64 - 1)
SEEDS = np.random.default_rng(20240229).integers(1, 2**63, SKETCHES, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
        return x ^ (x >> np.uint64(33))


def key_of(text: str | None) -> bytes:
    return hashlib.md5(" ".join((text or "").lower().split()).encode()).digest()


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Labelled shingles of all texts one after the other, and their number for each text."""
    import xxhash

    words = [t.lower().split() for t in texts]
    count = np.array([len(w) for w in words], np.int64)
    place: dict[str, int] = {}
    ids = np.fromiter((place.setdefault(w, len(place)) for ws in words for w in ws), np.int64, int(count.sum()))
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in place), np.uint64, len(place))
    h = hashes[ids] if len(ids) else np.zeros(0, np.uint64)
    starts = np.cumsum(count) - count
    rolled = np.zeros(len(h), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(WORDS):
            rolled[: len(h) - i] = rolled[: len(h) - i] * np.uint64(0x9E3779B97F4A7C15) + h[i:]
        number = np.where(count >= WORDS, count - WORDS + 1, np.minimum(count, 1))
        owner = np.repeat(np.arange(len(texts)), number)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number) + starts[owner]
        out = rolled[at]
        for i in np.flatnonzero((count > 0) & (count < WORDS)):  # all words of a short text
            v = np.uint64(count[i])
            for x in h[starts[i] : starts[i] + count[i]]:
                v = v * np.uint64(0x9E3779B97F4A7C15) + x
            out[np.cumsum(number)[i] - 1] = v
        out = _mix(out)
        tagged = _mix(out + owner.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
        order = np.argsort(tagged, kind="stable")
        same = np.concatenate(([False], tagged[order][1:] == tagged[order][:-1]))
        if same.any():
            run = np.arange(len(order)) - np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
            label = np.zeros(len(order), np.uint64)
            label[order] = run
            out = np.where(label > 0, _mix(out + label * np.uint64(0xA0761D6478BD642F)), out)
    return out, number


def sketches(labelled: np.ndarray, number: np.ndarray) -> np.ndarray:
    """For each text with any shingle a row of SKETCHES values (0 for the others)."""
    out = np.zeros((len(number), SKETCHES), np.uint64)
    full = np.flatnonzero(number > 0)
    if not len(full):
        return out
    n = number[full]
    starts = np.cumsum(n) - n
    owner = np.repeat(np.arange(len(n)), n)
    for j, seed in enumerate(SEEDS):
        value = _mix(labelled ^ seed)
        places = np.full((len(n), TUPLE), np.iinfo(np.int64).max)
        for t in range(TUPLE):
            hit = np.flatnonzero(value == np.minimum.reduceat(value, starts)[owner])
            who, first = np.unique(owner[hit], return_index=True)
            who, hit = who[n[who] > t], hit[first][n[who] > t]
            places[who, t] = hit
            value[hit] = MOST
        places.sort(axis=1)
        acc = np.full(len(n), np.uint64(j + 1))
        with np.errstate(over="ignore"):
            for t in range(TUPLE):
                there = places[:, t] < len(labelled)
                acc = np.where(there, _mix(acc * np.uint64(0x9E3779B97F4A7C15) + labelled[np.where(there, places[:, t], 0)]), acc)
        out[full, j] = acc
    return out


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """c / (n1 + n2 - c) with c the longest common subsequence inside the band; 0 where it can't reach SIMILAR."""
    n = len(a) + len(b)
    if not len(a) or not len(b) or min(len(a), len(b)) < SIMILAR * max(len(a), len(b)) - 1e-9:
        return 0.0
    order = np.argsort(b)
    ranked = b[order]
    at = np.minimum(np.searchsorted(ranked, a), len(b) - 1)
    i = np.flatnonzero(ranked[at] == a)
    j = order[at[i]]
    band = n * (1 - SIMILAR) / (1 + SIMILAR) + 1
    j = j[np.abs(i - j) <= band]
    if len(j) < (n - len(j)) * SIMILAR - 1e-9:
        return 0.0
    if (np.diff(j) > 0).all():
        c = len(j)
    else:
        tails: list[int] = []
        for x in j.tolist():
            k = bisect_left(tails, x)
            tails[k : k + 1] = [x]
        c = len(tails)
    return c / (n - c)


SKETCHED = "id long, key binary, n long, sketch array<long>"


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each row; n and sketch stand where the task first sees a text."""
    seen: set[bytes] = set()
    for batch in batches:
        for start in range(0, batch.num_rows, 500):
            part = batch.slice(start, 500)
            texts = part.column(1).to_pylist()
            keys = [key_of(t) for t in texts]
            new = []
            for i, k in enumerate(keys):
                if k not in seen:
                    seen.add(k)
                    new.append(i)
            labelled, number = shingles([texts[i] or "" for i in new])
            rows = sketches(labelled, number).view(np.int64).tolist()
            n, sketch = [None] * len(keys), [None] * len(keys)
            for i, m, s in zip(new, number.tolist(), rows, strict=True):
                n[i], sketch[i] = m, s if m else []
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(keys, pa.binary()), pa.array(n, pa.int64()), pa.array(sketch, pa.list_(pa.int64()))], ["id", "key", "n", "sketch"])
            if len(seen) > 500_000:
                seen.clear()
    trim_memory()


def _shingled(wanted):
    """Labelled shingles of the texts whose key the filter may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        bits = wanted.value
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                texts = batch.slice(start, 500).column(1).to_pylist()
                keys = [key_of(t) for t in texts]
                both = np.frombuffer(b"".join(keys), ">u8").reshape(-1, 2)
                block, bit = _places(both[:, 0], both[:, 1], len(bits) // BLOCK)
                at = block[:, None] * BLOCK * 8 + bit
                hit = ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)
                some = []
                for i in np.flatnonzero(hit):
                    if keys[i] not in seen:
                        seen.add(keys[i])
                        some.append(i)
                if some:
                    labelled, number = shingles([texts[i] or "" for i in some])
                    ends = np.cumsum(number)
                    rows = [labelled[e - m : e].tobytes() for e, m in zip(ends, number, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in some], pa.binary()), pa.array(rows, pa.binary())], ["k", "shingles"])

    return run


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right = batch.column("left_shingles"), batch.column("right_shingles")
        good = [similarity(np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")) >= SIMILAR - 1e-9 for x, y in zip(left, right, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))


def _group_pairs(rows: list[tuple]) -> Iterator[tuple[bytes, bytes]]:
    """Pairs of one group (bucket, n, key, comp, most; by n) between components, as far as ``n`` and ``most`` allow."""
    if len(rows) < 50:
        for i, (_, n, key, comp, most) in enumerate(rows):
            for _, m, other, of, reach in rows[i + 1 :]:
                if m > most:
                    break
                if of != comp and reach >= n:
                    yield key, other
        return
    _, n, keys, comps, most = zip(*rows, strict=True)
    n, most, comp = np.array(n), np.array(most), pd.factorize(np.array(comps, dtype=object))[0]
    for i in range(len(n)):
        js = np.arange(i + 1, np.searchsorted(n, most[i], side="right"))
        for j in js[(comp[js] != comp[i]) & (most[js] >= n[i])]:
            yield keys[i], keys[j]


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by bucket and n, the pairs of each bucket. One bucket is held at a time."""
    from itertools import chain, groupby
    from operator import itemgetter

    rows = chain.from_iterable(zip(*[c.to_pylist() for c in b.columns], strict=True) for b in batches)
    left, right = [], []

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], ["a", "b"])

    for _, group in groupby(rows, itemgetter(0)):
        for x, y in _group_pairs(list(group)):
            left.append(max(x, y))
            right.append(min(x, y))
            if len(left) == 100_000:
                yield out()
                left, right = [], []
    yield out()


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray]]:
    for batch in batches:
        for i, x in enumerate(batch.column("shingles")):
            yield batch, i, np.frombuffer(x.as_buffer(), "<u8")


def frequencies(texts: DataFrame, shingles: int) -> np.ndarray:
    """Counts of hashed shingles over ``texts(shingles)``, about ``shingles`` in all, each up to 255."""
    counters = min(MOST_COUNTERS, max(PIECE, 1 << (2 * shingles).bit_length()))

    def counted(places: list[np.ndarray]) -> pa.RecordBatch:
        at, n = np.unique(np.concatenate(places), return_counts=True)
        cut = np.searchsorted(at, np.arange(0, counters + 1, PIECE))
        rows = [(i, at[lo:hi].astype("<u4").tobytes(), n[lo:hi].astype("<u4").tobytes()) for i, (lo, hi) in enumerate(zip(cut, cut[1:], strict=False)) if hi > lo]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["piece", "at", "n"])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for _, _, x in _tokens(batches):
            held.append((x % np.uint64(counters)).astype(np.uint32))
            size += len(x)
            if size > 1_000_000:
                yield counted(held)
                held, size = [], 0
        if held:
            yield counted(held)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for r in batch.to_pylist():
                one = held.setdefault(r["piece"], np.zeros(PIECE, np.uint32))
                one[np.frombuffer(r["at"], "<u4") - r["piece"] * PIECE] += np.frombuffer(r["n"], "<u4")
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([np.minimum(v, 255).astype(np.uint8).tobytes() for v in held.values()], pa.binary())], ["piece", "n"])

    merged = texts.select("shingles").mapInArrow(part, "piece int, at binary, n binary").repartition("piece").mapInArrow(merge, "piece int, n binary")
    out = np.zeros(counters, np.uint8)
    for r in merged.collect():  # MOST_COUNTERS bytes at most
        out[r["piece"] * PIECE : (r["piece"] + 1) * PIECE] = np.frombuffer(r["n"], np.uint8)
    return out


def _prefix(counts):
    """Of each text the shingles of its prefix that another text may have, and how long that text may be at most.

    If two texts first meet at place p of one of n shingles, they share n - p at most; that bounds the other's length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = counts.value
        token, most, places, last = [], [], [], None
        for batch, i, x in _tokens(batches):
            if batch is not last:
                if last is not None:
                    yield _chosen(last, token, most, places)
                token, most, places, last = [], [], [], batch
            many = often[(x % np.uint64(len(often))).astype(np.int64)]
            length = min(len(x), len(x) - int(np.ceil(SIMILAR * len(x) - 1e-9)) + 1)
            first = np.lexsort((x, many))[:length]
            longest = np.minimum((len(x) - np.arange(length)) * (1 + SIMILAR) / SIMILAR - len(x), len(x) / SIMILAR)
            good = (many[first] > 1) & (longest >= SIMILAR * len(x) - 1e-9)
            token.append(x[first[good]])
            most.append(np.floor(longest[good] + 1e-9).astype(np.int64))
            places.append(np.full(int(good.sum()), i))
        if last is not None:
            yield _chosen(last, token, most, places)

    return run


def _chosen(batch: pa.RecordBatch, token: list, most: list, places: list) -> pa.RecordBatch:
    at = pa.array(np.concatenate(places))
    tokens = pa.array(np.concatenate(token).view(np.int64))
    return pa.RecordBatch.from_arrays([tokens, *(batch.column(c).take(at) for c in ("key", "comp", "n")), pa.array(np.concatenate(most))], ["bucket", "key", "comp", "n", "most"])


def components(links: DataFrame) -> DataFrame:
    """``key``, ``comp``: the least node of the component, for every node of ``links(a, b)``.

    Labels spread to neighbours by least label and are then followed to their own labels, until none changes.
    """
    both = materialize(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    label = materialize(both.groupBy(F.col("a").alias("key")).agg(F.min("b").alias("m")).select("key", F.least("key", "m").alias("comp")), "labels")
    while True:
        near = both.join(label.hint("merge"), F.col("b") == F.col("key")).groupBy("a").agg(F.min("comp").alias("m"))
        spread = label.join(near.hint("merge"), F.col("key") == F.col("a"), "left").select("key", F.col("comp").alias("old"), F.least("comp", "m").alias("new"))
        step = label.select(F.col("key").alias("k"), F.col("comp").alias("next"))
        jumped = spread.join(step.hint("merge"), F.col("new") == F.col("k"), "left").select("key", "old", F.least("new", F.coalesce("next", "new")).alias("comp"))
        jumped = materialize(jumped, "labels")
        drop_tables(label)
        done = not jumped.where("old != comp").limit(1).count()
        label = jumped.select("key", "comp")
        label._canopy_path = jumped._canopy_path
        if done:
            drop_tables(both)
            return label


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The links among ``pairs(a, b)``; the pairs are deleted."""
    left = texts.select(F.col("k").alias("kl"), F.col("shingles").alias("left_shingles"))
    right = texts.select(F.col("k").alias("kr"), F.col("shingles").alias("right_shingles"))
    full = pairs.hint("merge").join(left, F.col("a") == F.col("kl")).hint("merge").join(right, F.col("b") == F.col("kr"))
    links = materialize(full.select("a", "b", "left_shingles", "right_shingles").mapInArrow(_verify, "a binary, b binary"), "links")
    drop_tables(pairs)
    return links


def _halves() -> list:
    return [F.conv(F.hex(F.substring("a", s, 8)), 16, -10).cast("long") for s in (1, 9)]


def _linked(source: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) and components (key, comp) of ``nodes(key, n, sketch)``, whose texts are in ``source(id, text)``."""
    spark = source.sparkSession
    spots = nodes.select("key", F.posexplode("sketch").alias("j", "v")).select("key", F.xxhash64("j", "v").alias("bucket"))
    shared = spots.groupBy(F.col("bucket").alias("sb")).agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    placed = materialize(join_counted(spots, shared, {"bucket": "sb"}, "size", SKETCHES * nodes.count()).select("bucket", "key", "size"), "buckets")
    first = _to_hubs(placed)
    few = nodes.where((F.col("n") > 0) & (F.col("n") <= int(FEW / SIMILAR + 1e-9))).select("key")
    needed = materialize(first.select("a").union(first.select("b")).union(few).distinct(), "needed")
    count = needed.count()
    if not count:
        drop_tables(placed, needed)
        return first, materialize(first.select(F.col("a").alias("key"), F.col("b").alias("comp")), "labels")
    h1, h2 = _halves()
    wanted = spark.sparkContext.broadcast(bloom(needed.select(h1.alias("h1"), h2.alias("h2")), count))
    found = source.mapInArrow(_shingled(wanted), "k binary, shingles binary")
    texts = found.join(needed.hint("merge"), F.col("k") == F.col("a"), "left_semi").groupBy("k").agg(F.first("shingles").alias("shingles"))
    texts = materialize(texts, "shingles", "none")
    drop_tables(needed)
    release(spark)
    links = _verified(first, texts)
    comp = components(links)
    left = _mixed(placed, comp)
    drop_tables(placed)
    owner = comp.select(F.col("key").alias("ck"), "comp")
    few = few.join(owner.hint("merge"), F.col("key") == F.col("ck"), "left").select("key", F.coalesce("comp", "key").alias("comp"))
    every = materialize(left.select("key", "comp").union(few).distinct(), "residual-keys")
    drop_tables(left, comp)
    tokens = _shared_tokens(every, nodes, texts)
    drop_tables(every)
    sizes = tokens.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi")
    sizes = sizes.select(F.col("bucket").alias("sb"), "size")
    again = materialize(join_counted(tokens, sizes, {"bucket": "sb"}, "size", tokens.count()).select("bucket", "key", "n", "most", "size"), "tokens")
    drop_tables(tokens)
    release(spark)
    more = _verified(_to_hubs(again, bounded=True), texts)
    both = materialize(links.unionByName(more).distinct(), "links")
    drop_tables(links, more)
    comp = components(both)
    rest = _mixed(again, comp)
    drop_tables(again)
    pairs = rest.select("bucket", "n", "key", "comp", "most").repartition("bucket").sortWithinPartitions("bucket", "n")
    pairs = materialize(pairs.mapInArrow(_pairs, "a binary, b binary").distinct(), "pairs")
    drop_tables(rest)
    more = _verified(pairs, texts)
    if more.limit(1).count():
        every = materialize(both.unionByName(more).distinct(), "links")
        drop_tables(both, comp)
        both, comp = every, components(every)
    drop_tables(more, texts)
    return both, comp


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id (the least id of its class), class_size, n_links (verified links of its text), for each row.

    Ids are integers; others count as null.
    """
    small_batches(docs.sparkSession)
    source = pick(docs, id=id_col, text=text_col).select(as_id(F.col("id")).alias("id"), F.col("text").cast("string"))
    rows = materialize(source.mapInArrow(_sketch, SKETCHED), "sketched")
    nodes = rows.where("n is not null").groupBy("key").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    nodes = materialize(nodes, "nodes")
    slim = rows.select("id", "key")
    links, comp = _linked(source, nodes)
    drop_tables(nodes)
    degree = links.select("a").union(links.select("b")).groupBy(F.col("a").alias("dk")).agg(F.count(F.lit(1)).alias("n_links"))
    by_key = slim.groupBy("key").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"))
    owner = comp.select(F.col("key").alias("ck"), "comp")
    by_key = by_key.join(owner.hint("merge"), F.col("key") == F.col("ck"), "left").join(degree.hint("merge"), F.col("key") == F.col("dk"), "left")
    by_key = materialize(by_key.select("key", F.coalesce("comp", "key").alias("comp"), "least", "copies", F.coalesce("n_links", F.lit(0)).alias("n_links")), "keys")
    drop_tables(links, comp)
    whole = by_key.groupBy(F.col("comp").alias("c")).agg(F.min("least").alias("class_id"), F.sum("copies").alias("class_size"), F.count(F.lit(1)).alias("texts"))
    named = join_counted(by_key, whole, {"comp": "c"}, "texts", by_key.count())
    named = materialize(named.select(F.col("key").alias("nk"), "class_id", "class_size", "n_links", "copies"), "named")
    drop_tables(by_key)
    release(docs.sparkSession)
    out = join_counted(slim, named, {"key": "nk"}, "copies", slim.count())
    return out.select(F.col("id").alias("doc_id"), "class_id", "class_size", "n_links")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class, that of the least id (null last; of equal ids the first read)."""
    names = docs.columns
    flat = docs.toDF(*[f"c{i}" for i in range(len(names))])
    stored = materialize(flat.withColumn("row", F.monotonically_increasing_id()), "documents")
    of = classes(stored.select("row", F.col(f"c{names.index(text_col)}").alias("text")), "row", "text")
    ids = stored.select(F.col("row").alias("r"), F.coalesce(as_id(F.col(f"c{names.index(id_col)}")), F.lit((1 << 63) - 1)).alias("id"))
    best = of.join(ids.hint("merge"), F.col("doc_id") == F.col("r")).groupBy("class_id").agg(F.min(F.struct("id", "r")).alias("m")).select(F.col("m.r").alias("kept"))
    best = materialize(best, "kept")
    release(docs.sparkSession)
    return stored.join(best.hint("merge"), F.col("row") == F.col("kept"), "left_semi").select(*flat.columns).toDF(*names)


def _to_hubs(placed: DataFrame, bounded: bool = False) -> DataFrame:
    """Pairs of each node of ``placed(bucket, key, size)`` with the hub of its bucket, once each; ``bounded``: by n and most."""
    degree = placed.select("key", "size").groupBy("key").agg(F.sum("size").alias("degree")).withColumnRenamed("key", "dk")
    own = ["n", "most"] if bounded else []
    hub = F.max(F.struct("degree", "key", *own)).alias("hub")
    ranked = placed.join(degree.hint("merge"), F.col("key") == F.col("dk")).groupBy("bucket")
    hubs = ranked.agg(hub, F.count(F.lit(1)).alias("members")).select(F.col("bucket").alias("hb"), "hub", "members")
    pairs = join_counted(placed, hubs, {"bucket": "hb"}, "members", placed.count()).where("key != hub.key")
    if bounded:
        pairs = pairs.where("n <= hub.most AND hub.n <= most")
    return materialize(pairs.select(F.greatest("key", "hub.key").alias("a"), F.least("key", "hub.key").alias("b")).distinct(), "pairs")


def _mixed(placed: DataFrame, comp: DataFrame) -> DataFrame:
    """Rows of ``placed`` in buckets of several components, plus comp."""
    owner = comp.select(F.col("key").alias("ck"), "comp")
    of = materialize(placed.join(owner.hint("merge"), F.col("key") == F.col("ck"), "left").withColumn("comp", F.coalesce("comp", "key")).drop("ck"), "owned")
    mixed = of.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("members")).where("lo != hi")
    mixed = mixed.select(F.col("bucket").alias("mb"), "members")
    out = materialize(join_counted(of, mixed, {"bucket": "mb"}, "members", of.count()).drop("mb", "members"), "mixed-rows")
    drop_tables(of)
    return out


def _shared_tokens(keys: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """bucket (a shingle), key, comp, n: prefix shingles of the nodes ``keys(key, comp)`` that several of them may have."""
    sizes = nodes.select(F.col("key").alias("nk"), "n")
    sized = keys.join(sizes.hint("merge"), F.col("key") == F.col("nk")).join(texts.hint("merge"), F.col("key") == F.col("k")).select("key", "comp", "n", "shingles")
    sized = materialize(sized, "residual", "none")
    total = sized.agg(F.sum("n")).first()[0] or 0
    counts = keys.sparkSession.sparkContext.broadcast(frequencies(sized, total))
    tokens = materialize(sized.mapInArrow(_prefix(counts), "bucket long, key binary, comp binary, n long, most long"), "tokens")
    drop_tables(sized)
    return tokens


def op10_near(spark, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
