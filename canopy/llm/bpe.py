"""Byte-pair encoding and decoding by forced-boundary splitting.

A text is parted by white space, which no token crosses. The words, each distinct one once for a worker as far as its
bounded cache reaches, go through the tokenizer's normalizer and pre-tokenizer. A pair of neighbouring bytes that occurs
inside no token of the vocabulary can never be merged, so a cut between them is certain: each pre-token is cut there,
wherever in a word that is. The fragments are encoded independently, and the results are put together again. Only the
last fragment of a pre-token ends a word, so it alone is encoded with the mark that the model gives to ends of words;
all others are encoded by the same model without that mark. Words that may hold a special token (the library finds these
before anything else) are encoded whole by the library itself.

Nulls count as empty texts: no ids, an empty decoded text. Repeated rows give repeated results. Texts of any length are
held one Arrow batch at a time. Words of more than ``LONG`` characters (long texts without white space are one) are
encoded each time they occur; the cache holds shorter ones, up to ``CACHE_BYTES`` in each of its two generations. Ids are
integers; others count as null. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.llm.shared import as_id, pick, small_batches, trim_memory

#: Of each of the two generations of a worker's cache, as estimated; and words beyond this length are not kept.
#: Both bound memory, never the result.
CACHE_BYTES, LONG = 96 << 20, 256

#: Python's split() takes these four for white space, Unicode and the tokenizers don't.
SEPARATORS = re.compile("[\x1c-\x1f]")
BLANKS = re.compile("[ \t\n\x0b\x0c\r]+")

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids binary, decoded string"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies, by rule: printable Latin-1 stands for itself, the rest follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def inner_pairs(vocabulary: list[str], suffix: str) -> set[tuple[int, int]]:
    """All pairs of neighbouring bytes inside any token."""
    alphabet, pairs = _byte_alphabet(), set()
    for token in vocabulary:
        body = token.removesuffix(suffix) if suffix else token
        raw = [alphabet[c] for c in body if c in alphabet]
        pairs.update(zip(raw, raw[1:], strict=False))
    return pairs


class Encoder:
    """A tokenizer behind a cache of words."""

    def __init__(self, path: str, most: int = CACHE_BYTES):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.special = tuple(t["content"][:2] for t in spec["added_tokens"])
        suffix = spec["model"].get("end_of_word_suffix") or ""
        unmarked = {**spec, "added_tokens": [], "model": {**spec["model"], "end_of_word_suffix": None}}
        self.last, self.inner = self.tokenizer.model, Tokenizer.from_str(json.dumps(unmarked)).model
        self.letters = {b: c for c, b in _byte_alphabet().items()}
        self.joined = {self.letters[a] + self.letters[b] for a, b in inner_pairs(list(spec["model"]["vocab"]), suffix)}
        self.names = [self.tokenizer.id_to_token(i) for i in range(self.tokenizer.get_vocab_size())]
        self.most, self.held = most, 0
        self.known: dict[str, tuple[bytes, str]] = {}  # words
        self.older: dict[str, tuple[bytes, str]] = {}

    def pieces(self, word: str) -> list[str]:
        """The pre-tokens of a word without white space and special tokens, in the letters that stand for bytes."""
        if word.isascii():  # without the library where its rules are plain: letters alone, or with one sign after them
            if word.isalpha():
                return [word.lower()]
            if word[:-1].isalpha() and not word[-1].isalnum() and word[-1] > " ":
                return [word[:-1].lower(), word[-1]]
        elif word.isalpha() and max(word) <= "\u00ff":
            return [word.lower().encode().decode("latin-1").translate(self.letters)]
        return [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(word))]

    def split(self, piece: str) -> list[str]:
        """The fragments of a pre-token."""
        out, start = [], 0
        for i in range(1, len(piece)):
            if piece[i - 1 : i + 1] not in self.joined:
                out.append(piece[start:i])
                start = i
        return [*out, piece[start:]]

    def learn(self, word: str) -> tuple[bytes, str]:
        """Ids (little-endian unsigned 32-bit integers) and tokens (joined by blanks) of a word."""
        if any(s in word for s in self.special):
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        else:
            ids = []
            for piece in self.pieces(word):
                *inner, last = self.split(piece)
                for part in inner:
                    ids += [t.id for t in self.inner.tokenize(part)]
                ids += [t.id for t in self.last.tokenize(last)]
        return struct.pack(f"<{len(ids)}I", *ids), " ".join([self.names[i] for i in ids])

    def encode(self, text: str) -> tuple[bytes, str]:
        """Ids as little-endian unsigned 32-bit integers, and the decoded text: the tokens joined by blanks."""
        words = text.split() if not SEPARATORS.search(text) else [w for w in BLANKS.split(text) if w]
        known, older, long = self.known, self.older, {}
        for w in set(words):
            if w not in known:
                got = older.get(w) or self.learn(w)
                if len(w) > LONG:
                    long[w] = got
                else:
                    known[w] = got
                    self.held += 300 + 2 * len(w) + len(got[0]) + len(got[1])
        got = [known[w] for w in words] if not long else [known.get(w) or long[w] for w in words]
        if self.held > self.most:  # what is used goes on from one generation to the next
            self.older, self.known, self.held = known, {}, 0
        return b"".join([g[0] for g in got]), " ".join([g[1] for g in got if g[0]])

    def rest(self) -> None:
        """Between tasks a worker holds no cache: the memory may be needed by other steps."""
        self.known, self.older, self.held = {}, {}, 0
        trim_memory()


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str, most: int) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    _ENCODERS[path].most = most
    return _ENCODERS[path]


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", digests_only: bool = False, cache_bytes: int = CACHE_BYTES) -> DataFrame:
    """One row for each row of ``docs``: number of tokens, digests, and (unless ``digests_only``) ids and decoded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(tokenizer_path, cache_bytes)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            rows: list[list] = [[] for _ in range(6)]
            held = 0
            start = 0
            for at in range(batch.num_rows):
                raw, decoded = coder.encode(texts[at].as_py() or "")
                values = (len(raw) // 4, hashlib.sha256(raw).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
                for out, v in zip(rows[1:], values if digests_only else (*values, raw, decoded), strict=False):
                    out.append(v)
                held += 0 if digests_only else len(raw) + len(decoded)
                if held > 16 << 20 or at == batch.num_rows - 1:
                    rows[0] = ids.slice(start, at + 1 - start)
                    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string())
                    names = ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded")
                    n = 4 if digests_only else 6
                    yield pa.RecordBatch.from_arrays([pa.array(r, k) if i else r.cast(k) for i, (r, k) in enumerate(zip(rows[:n], kinds[:n], strict=True))], names[:n])
                    rows, held, start = [[] for _ in range(6)], 0, at + 1
        coder.rest()

    small_batches(docs.sparkSession)
    source = pick(docs, id=id_col, text=text_col).select(as_id(F.col("id")).alias("id"), F.col("text").cast("string"))
    return source.mapInArrow(run, DIGESTS if digests_only else SCHEMA)


def op7_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), digests_only=True)
