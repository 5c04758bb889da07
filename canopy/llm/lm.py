"""Language-model scoring by a weighted backoff automaton.

Tokens: the words of a text (A-Z lower-cased, parted by blank and U+0009 to U+000D) and one end. The model is of order
``ORDER``, interpolated with weights by classes of context frequency (bucketed Jelinek-Mercer):

    P0(w)    = (c(w) + 0.5) / (N + 0.5 (V + 1))
    P(w|h)   = (1 - a(h)) c(hw) / c(h) + a(h) P(w|h')        h' is h without its first word; P(w|) = P0(w)

where a(h) is the share of once-seen successors among all successors of contexts of the same length that are as frequent
as h (powers of two). A text's first word has the context "begin", the second "begin" and the first word, and so on.

The automaton: states are the contexts seen in training, from the root (no context) to ORDER - 1 words. A seen n-gram is
an arc from its context, weighted log10 P(w|h), to the longest context that it ends in. Any other word leaves a state by
its failure arc, weighted log10 a(h), to the state of h'. The root has an arc for every word, weighted log10 P0(w). One
left-to-right pass carries the state, adds up weights, and follows failure arcs until a word's arc is found.

No machine holds the whole automaton. Texts are packed into blocks of bounded size. For each order a block asks for its
distinct n-grams: it sends sorted hashes with its own training counts to shards by range of hash; a shard adds up and
answers with the totals. With these each block builds the part of the automaton that its texts can reach, and passes its
texts through it, in lanes of ``LANE`` tokens at a time: as a state depends on the last ORDER - 1 words alone, a lane
that starts inside a text takes a run-up of so many words, whose weights don't count, and is then in the state that a
single pass would have reached. ``Automaton`` is the same over texts in memory, one word at a time.

Shards grow in number with the input, so that none outgrows a task. Blocks times shards are the rows of an exchange, but
never more than there are n-grams: a shard is sent nothing if a block has none for it. Words have 64-bit hashes, longer
n-grams 56-bit ones; two that share a hash add up their counts. Among 10^9 different words the chance of any such pair
is 3 %; of 10^9 n-grams about 14 have a partner. Counts are 64-bit integers.

Rows whose id's CRC-32 (of its decimal text; null: of the empty text) is 1 modulo 5 are held out of training. Null texts
count as empty: one token, the end. Repeated rows are separate texts. No training rows: N = V = 0, and all scores are
those of P0. Empty table: empty result. Ids are integers; others count as null. Other columns are ignored.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.llm.shared import as_id, drop_tables, materialize, pick, release, small_batches

ORDER, BLOCK_TOKENS, SHARD_CHARS, CLASSES, LANE = 3, 500_000, 8 << 20, 64, 256
END = np.uint64(0x9E3779B97F4A7C15)  # stands for the hash of the end, and of the begin as a context


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 1


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of pairs."""
    with np.errstate(over="ignore"):
        x = a * np.uint64(0xFF51AFD7ED558CCD) + (b ^ np.uint64(0xC4CEB9FE1A85EC53)) * np.uint64(0x9FB21C651E98DF25)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def _pack(x: np.ndarray) -> bytes:
    """Sorted hashes as differences, of as few bytes as the largest takes."""
    if not len(x):
        return b""
    d = np.diff(x, prepend=x[:1])
    n = max(1, (int(d.max()).bit_length() + 7) // 8)
    return bytes([n]) + int(x[0]).to_bytes(8, "little") + np.ascontiguousarray(d.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n]).tobytes()


def _unpack(b: bytes) -> np.ndarray:
    if not b:
        return np.zeros(0, np.uint64)
    n = b[0]
    body = np.frombuffer(b, np.uint8, offset=9).reshape(-1, n)
    d = np.zeros((len(body), 8), np.uint8)
    d[:, :n] = body
    d = d.view("<u8").ravel().astype(np.uint64)
    d[0] = int.from_bytes(b[1:9], "little")
    return np.cumsum(d, dtype=np.uint64)


def _small(x: np.ndarray) -> bytes:
    """Numbers from 0 on, of 4 bytes or 8 where one needs them; all first bytes, then all second ones, ..., compressed."""
    width = 8 if len(x) and int(x.max()) >= 1 << 32 else 4
    planes = np.ascontiguousarray(x, f"<u{width}").view(np.uint8).reshape(-1, width).T
    return bytes([width]) + len(x).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _large(b: bytes) -> np.ndarray:
    width, n = b[0], int.from_bytes(b[1:9], "little")
    if not n:
        return np.zeros(0, np.int64)
    planes = np.frombuffer(pa.decompress(b[9:], n * width, codec="zstd", asbytes=True), np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").ravel().astype(np.int64)


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows one by one: a block is large."""
    for i in range(batch.num_rows):
        yield {name: batch.column(name)[i].as_py() for name in batch.schema.names}


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


D_SCHEMA = "block string, doc_ids binary, nulls binary, lengths binary, hashes binary, tokens binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pack texts into blocks: ids, numbers of words, hashes of the distinct words, words as places among those."""
    import xxhash

    held: list[tuple] = []
    size = 0

    def out() -> pa.RecordBatch:
        ids = pa.concat_arrays([h[0] for h in held])
        lengths = np.concatenate([h[1] for h in held])
        hashes, inverse = np.unique(np.concatenate([h[2] for h in held]), return_inverse=True)
        starts = np.cumsum([0] + [len(h[2]) for h in held])[:-1]
        tokens = np.concatenate([inverse[s + h[3]] for s, h in zip(starts, held, strict=True)]) if size else np.zeros(0)
        row = (uuid.uuid4().hex, ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes(), ids.is_null().to_numpy(zero_copy_only=False).tobytes(), _small(lengths), _pack(hashes), _small(tokens))
        return pa.RecordBatch.from_arrays([pa.array([row[0]])] + [pa.array([x], pa.binary()) for x in row[1:]], _names(D_SCHEMA))

    for batch in batches:
        start = 0
        while start < batch.num_rows:
            part = batch.slice(start, 500)
            start += 500
            words = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(part.column(1), "")))
            flat = words.flatten()
            full = pc.not_equal(pc.binary_length(flat), 0)
            owner = np.repeat(np.arange(len(words)), words.value_lengths().to_numpy(zero_copy_only=False))[full.to_numpy(zero_copy_only=False)]
            coded = flat.filter(full).dictionary_encode()
            hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.cast(pa.binary()).to_pylist()), np.uint64, len(coded.dictionary))
            held.append((part.column(0), np.bincount(owner, minlength=part.num_rows), hashes, coded.indices.to_numpy()))
            size += len(owner)
            if size >= BLOCK_TOKENS:
                yield out()
                held, size = [], 0
    if held:
        yield out()


class _Block:
    """A block's texts with ends put in: ``token`` are places in ``words``, the sorted hashes of its words and the end."""

    def __init__(self, row):
        self.ids = np.frombuffer(row["doc_ids"], "<i8")
        self.nulls = np.frombuffer(row["nulls"], bool)
        self.lengths = _large(row["lengths"]) + 1
        hashes = _unpack(row["hashes"])
        self.words = np.unique(np.append(hashes, END))
        self.end = int(np.searchsorted(self.words, END))
        self.starts = np.cumsum(self.lengths) - self.lengths
        total = int(self.lengths.sum())
        is_end = np.zeros(total, bool)
        is_end[self.starts + self.lengths - 1] = True
        self.token = np.full(total, self.end, np.int32)
        self.token[~is_end] = np.searchsorted(self.words, hashes).astype(np.int32)[_large(row["tokens"])]
        self.offset = np.arange(total) - np.repeat(self.starts, self.lengths)
        self.held = np.array([held_out(None if null else int(i)) for i, null in zip(self.ids, self.nulls, strict=True)], bool)
        self.train = np.repeat(~self.held, self.lengths)

    def grams(self, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """By order: sorted hashes of the distinct n-grams, where n-grams end, and which of the distinct each is."""
        every = np.arange(len(self.token))
        yield 1, self.words, every, self.token
        own = self.words[self.token]
        hashes = np.where(self.offset > 0, np.roll(own, 1), END)  # the begin has the hash of the end
        for n in range(2, most + 1):
            hashes = _mix(hashes if n == 2 else np.roll(hashes, 1), own)
            ends = every if n == 2 else np.flatnonzero(self.offset >= n - 2)
            distinct, which = np.unique((hashes[ends] >> np.uint64(8)) << np.uint64(8), return_inverse=True)
            yield n, distinct, ends, which.astype(np.int32)


def _cuts(x: np.ndarray, shards: int) -> np.ndarray:
    """Bounds of the shards in sorted hashes; shards is a power of two."""
    bits = np.uint64(64 - (shards.bit_length() - 1))
    edges = (np.arange(1, shards, dtype=np.uint64) << bits) if shards > 1 else np.zeros(0, np.uint64)
    return np.concatenate(([0], np.searchsorted(x, edges), [len(x)]))


ASK = "shard int, block string, h binary, c binary"


def _ask(order: int, shards: int):
    """What each block sends to each shard: hashes of its distinct n-grams, and how often they occur in training."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                b = _Block(row)
                *_, (_, distinct, ends, which) = b.grams(order)
                counts, cut = np.bincount(which[b.train[ends]], minlength=len(distinct)), _cuts(distinct, shards)
                if order > 1:
                    distinct = distinct >> np.uint64(8)
                rows = [(s, row["block"], _pack(distinct[lo:hi]), _small(counts[lo:hi])) for s, (lo, hi) in enumerate(zip(cut, cut[1:], strict=False)) if hi > lo]
                cols = list(zip(*rows, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.string(), pa.binary(), pa.binary()), strict=True)], _names(ASK))

    return run


ANSWER = "shard int, block string, t binary, n long, v long"


def _answer(asked: pd.DataFrame) -> pd.DataFrame:
    """A shard's totals for each block that asked; in its first row n (occurrences) and v (distinct n-grams) of the shard."""
    parts = [_unpack(x) for x in asked["h"]]
    every, inverse = np.unique(np.concatenate(parts), return_inverse=True)
    total = np.bincount(inverse, weights=np.concatenate([_large(x) for x in asked["c"]]), minlength=len(every)).astype(np.int64)  # exact below 2^53
    ends = np.cumsum([len(p) for p in parts])
    first = np.arange(len(asked)) == 0
    answers = [_small(total[inverse[e - len(p) : e]]) for p, e in zip(parts, ends, strict=True)]
    return pd.DataFrame({"shard": asked["shard"], "block": asked["block"], "t": answers, "n": np.where(first, total.sum(), 0), "v": np.where(first, (total > 0).sum(), 0)})


KNOWN = D_SCHEMA + ", counts array<binary>, successors array<long>, once array<long>"


def _class(c: np.ndarray) -> np.ndarray:
    return np.log2(np.maximum(c, 1)).astype(np.int64)


def _context(b: _Block, n: int, ends: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """Which (n-1)-grams are the contexts of the n-grams that end at ``ends``; ``shorter``: by where they end."""
    return np.where(b.offset[ends] > 0, shorter[ends - 1], b.end) if n == 2 else shorter[ends - 1]


def _join(order: int):
    """A block with the counts of its distinct n-grams, and its training successors by length and frequency of contexts."""

    def run(blocks: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(blocks):
            return pd.DataFrame(columns=_names(KNOWN))
        row = blocks.iloc[0]
        answers = answers.sort_values(["order", "shard"])
        none = np.zeros(0, np.int64)  # a block of empty texts has no longer n-grams
        counts = [np.concatenate([none, *[_large(x) for x in answers["t"][answers["order"] == n]]]) for n in range(1, order + 1)]
        b, successors, once = _Block(row), [], []
        for n, _, ends, which in b.grams(order):
            if n > 1:
                train = ends[b.train[ends]]
                mine = which[b.train[ends]]
                kind = _class(counts[n - 2][_context(b, n, train, by_end)])
                successors.append(np.bincount(kind, minlength=CLASSES))
                once.append(np.bincount(kind[counts[n - 1][mine] == 1], minlength=CLASSES))
            by_end = np.zeros(len(b.token), np.int32)
            by_end[ends] = which
        return pd.DataFrame([(*[row[x] for x in _names(D_SCHEMA)], [_small(c) for c in counts], np.concatenate(successors), np.concatenate(once))], columns=_names(KNOWN))

    return run


def leaving(n: float, once: float) -> float:
    """Weight of the failure arc for a class with n successors, ``once`` of them seen once."""
    return (once + 0.5) / (n + 1.0)


class _Machine:
    """The part of the automaton that a block's texts can reach. State 0 is the root, 1 + w the context of word w alone."""

    def __init__(self, b: _Block, counts: list[np.ndarray], leave: np.ndarray, n: int, v: int):
        words, order = len(b.words), len(counts)
        self.words = words
        p = (counts[0] + 0.5) / (n + 0.5 * (v + 1))
        self.root_weight = np.log10(p)
        self.root_next = np.where(counts[0] > 0, np.arange(words) + 1, 0)
        self.begin = int(self.root_next[b.end])
        fail_weight, fail = [np.zeros(1), np.log10(leave[0][_class(counts[0])])], [np.zeros(1 + words, np.int64)]
        keys, weights, nexts = [], [], []
        base = 1  # states of the contexts one word shorter
        for k, distinct, ends, which in b.grams(order):
            if k > 1:
                at = np.zeros(len(distinct), np.int64)
                at[which] = ends  # a place of each n-gram
                mine, word = counts[k - 1], b.token[at]
                context, suffix = _context(b, k, at, by_end), by_end[at]
                a = leave[k - 2][_class(counts[k - 2][context])]
                p = (1 - a) * mine / np.maximum(counts[k - 2][context], 1) + a * p[suffix]
                seen = np.flatnonzero(mine > 0)
                keys.append((base + context[seen]).astype(np.int64) * words + word[seen])
                weights.append(np.log10(p[seen]))
                if k < order:
                    above = base + len(counts[k - 2])
                    nexts.append(above + seen)
                    fail_weight.append(np.log10(leave[k - 1][_class(mine)]))
                    fail.append(base + suffix)
                    base = above
                else:
                    nexts.append(base + suffix[seen])
            by_end = np.zeros(len(b.token), np.int32)
            by_end[ends] = which
        self.fail_weight, self.fail = np.concatenate(fail_weight), np.concatenate(fail).astype(np.int64)
        key = np.concatenate(keys)
        by = np.argsort(key)
        self.key = np.append(key[by], np.int64((1 << 63) - 1))
        self.weight, self.next = np.concatenate(weights)[by], np.concatenate(nexts)[by].astype(np.int64)

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states, and the weights of the arcs taken, failure arcs among them."""
        weight, after, state = np.zeros(len(state)), np.zeros(len(state), np.int64), state.copy()
        todo = np.arange(len(state))
        while len(todo):
            top = state[todo] == 0
            here = todo[top]
            weight[here] += self.root_weight[word[here]]
            after[here] = self.root_next[word[here]]
            todo = todo[~top]
            key = state[todo] * self.words + word[todo]
            at = np.searchsorted(self.key, key)
            hit = self.key[at] == key
            here, at = todo[hit], at[hit]
            weight[here] += self.weight[at]
            after[here] = self.next[at]
            todo = todo[~hit]
            weight[todo] += self.fail_weight[state[todo]]
            state[todo] = self.fail[state[todo]]
        return after, weight

    def run(self, b: _Block, run_up: int) -> np.ndarray:
        """Scores of the block's texts."""
        pieces = -(-b.lengths // LANE)
        text = np.repeat(np.arange(len(b.lengths)), pieces)
        inside = (np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * LANE
        before = np.minimum(inside, run_up)
        length = before + np.minimum(b.lengths[text] - inside, LANE)
        by = np.argsort(-length, kind="stable")
        text, inside, before, length = text[by], inside[by], before[by], length[by]
        first = b.starts[text] + inside - before
        state = np.where(inside == before, self.begin, 0)  # others are set right by their run-up
        score = np.zeros(len(text))
        for t in range(int(length[0]) if len(length) else 0):
            lanes = int(np.searchsorted(-length, -t, side="left"))  # those longer than t
            state[:lanes], weight = self.step(state[:lanes], b.token[first[:lanes] + t])
            score[:lanes] += np.where(before[:lanes] <= t, weight, 0.0)
        return np.bincount(text, weights=score, minlength=len(b.lengths))


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """One row for each row of ``docs``, see SCORES; base_score is that of P0 alone. ``order``: 2 or more."""
    spark = docs.sparkSession
    small_batches(spark)
    source = pick(docs, id=id_col, text=text_col).select(as_id(F.col("id")).alias("id"), F.col("text").cast("string"))
    chars = source.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = 1 << max(0, math.ceil(math.log2(max(1, chars / SHARD_CHARS))))
    blocks = materialize(source.mapInArrow(_blocks, D_SCHEMA), "lm-blocks", "none")
    answers = []
    for n in range(1, order + 1):
        answers.append(materialize(blocks.mapInArrow(_ask(n, shards), ASK).groupBy("shard").applyInPandas(_answer, ANSWER), "lm-answers", "none"))
        release(spark)
    sums = answers[0].agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    n, v = sums["n"] or 0, sums["v"] or 0
    every = reduce(DataFrame.unionByName, [a.select("block", "shard", "t", F.lit(i + 1).alias("order")) for i, a in enumerate(answers)])
    known = materialize(blocks.groupBy("block").cogroup(every.groupBy("block")).applyInPandas(_join(order), KNOWN), "lm-known", "none")
    drop_tables(blocks, *answers)
    release(spark)
    size = (order - 1) * CLASSES
    kinds = known.select(F.posexplode(F.arrays_zip("successors", "once")).alias("kind", "s"))
    kinds = kinds.groupBy("kind").agg(F.sum("s.successors").alias("n"), F.sum("s.once").alias("once")).collect()  # (order - 1) x CLASSES rows
    leave = np.full(size, leaving(0, 0))
    for r in kinds:
        leave[r["kind"]] = leaving(r["n"], r["once"])
    leave = leave.reshape(order - 1, CLASSES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch.select([*_names(D_SCHEMA), "counts"])):
                b, counts = _Block(row), [_large(c) for c in row["counts"]]
                base = np.log10((counts[0] + 0.5) / (n + 0.5 * (v + 1)))[b.token]
                cols = [
                    pa.array(b.ids, pa.int64(), mask=b.nulls), pa.array(b.held), pa.array(b.lengths), pa.array(np.add.reduceat((counts[0] > 0)[b.token].astype(np.int64), b.starts)),
                    pa.array(np.full(len(b.ids), n, np.int64)), pa.array(np.add.reduceat(base, b.starts)), pa.array(_Machine(b, counts, leave, n, v).run(b, order - 1)),
                ]
                yield pa.RecordBatch.from_arrays(cols, _names(SCORES))

    return known.drop("successors", "once").mapInArrow(run, SCORES)


class Automaton:
    """The same model over texts in memory, state by state. States are tuples of words; the begin is one."""

    ROOT, BEGIN, STOP = (), ("begin",), ("end",)

    def __init__(self, training: list[str | None], order: int = ORDER):
        self.order = order
        grams = [Counter() for _ in range(order + 1)]
        for text in training:
            words = [self.BEGIN, *self.words(text), self.STOP]
            for k in range(1, order + 1):
                grams[k].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
        self.c = Counter({g[0]: n for g, n in grams[1].items() if g[0] != self.BEGIN})
        self.n, self.v = sum(self.c.values()), len(self.c)
        leave = [[0.5] * CLASSES for _ in range(order + 1)]
        for k in range(2, order + 1):
            n, once = [0] * CLASSES, [0] * CLASSES
            for g, count in grams[k].items():
                kind = grams[k - 1][g[:-1]].bit_length() - 1
                n[kind] += count
                once[kind] += count == 1
            leave[k - 1] = [leaving(a, b) for a, b in zip(n, once, strict=True)]
        away = lambda h: leave[len(h)][grams[len(h)][h].bit_length() - 1]
        self.fail = {g: math.log10(away(g)) for k in range(1, order) for g in grams[k]}
        self.p = {(w,): self.p0(w) for w in self.c}
        self.arcs: dict = {}
        for k in range(2, order + 1):
            for g, count in grams[k].items():
                a = away(g[:-1])
                self.p[g] = (1 - a) * count / grams[k - 1][g[:-1]] + a * self.p[g[1:]]
                self.arcs.setdefault(g[:-1], {})[g[-1]] = math.log10(self.p[g])

    @staticmethod
    def words(text: str | None) -> list:
        return (text or "").encode().lower().split()

    def p0(self, w) -> float:
        return (self.c[w] + 0.5) / (self.n + 0.5 * (self.v + 1))

    def step(self, state: tuple, word) -> tuple[tuple, float]:
        """The next state, and the weight of the arcs taken."""
        weight = 0.0
        while True:
            arc = math.log10(self.p0(word)) if state == self.ROOT else self.arcs.get(state, {}).get(word)
            if arc is not None:
                after = (*state, word)[-(self.order - 1) :]
                return (after if after in self.fail else self.ROOT), weight + arc
            weight += self.fail[state]
            state = state[1:]

    def score(self, text: str | None) -> float:
        state, total = ((self.BEGIN,) if (self.BEGIN,) in self.fail else self.ROOT), 0.0
        for w in [*self.words(text), self.STOP]:
            state, weight = self.step(state, w)
            total += weight
        return total


def op3_lm(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
