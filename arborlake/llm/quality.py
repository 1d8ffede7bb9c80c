"""Quality classification by supervised subword embeddings.

A document is the average of learned vectors: of its words, of their character n-grams, and of its
word pairs, each hashed to one of ``BUCKETS`` rows. A softmax over two classes follows. Vectors and
output are trained together by stochastic gradient descent in numpy, on at most about ``SAMPLE_DOCS``
labelled documents chosen by hash. A pair of equal words is hashed as a back-reference, so that
repetition is learned for all words at once.

For scoring, each bucket's vector is reduced to the one number by which it moves the logit; so what
goes to the executors is ``BUCKETS`` floats, whatever the corpus. Whole texts are scored where they
are read; nothing is shuffled. The n-grams of a text's new words are hashed together, in numpy.

Defined results: null and empty texts have no features and score by the learned bias; if no label
can be learned from, every score is 0.5, and if all are alike, the bias says so; each row of labels
counts, repeated and contradicting ones too; other columns aren't read.
"""

from __future__ import annotations

import math
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake.llm.textops import remainder, table

BUCKETS, DIM, EPOCHS, STEPS, RATE, SAMPLE_DOCS, FOLD, THRESHOLD, SEED = 1 << 18, 8, 12, 10_000, 0.5, 3000, 5, 0.3, 7
WORDS_KEPT, AT_ONCE = 200_000, 4096
_REPEAT = 0x9E3779B1


LONG = 64


def word_features(word: str, buckets: int = BUCKETS) -> list[int] | np.ndarray:
    """Buckets of the word and of all its character 3- and 4-grams between pads; of a long word as an array, which takes 8 bytes each."""
    s = f"<{word}>"
    if len(word) > LONG:
        parts = chain((b"w" + word.encode("utf-8", "replace"),), (s[i : i + n].encode("utf-8", "replace") for n in (3, 4) for i in range(len(s) - n + 1)))
        return np.fromiter((zlib.crc32(x) % buckets for x in parts), np.int64)
    out = [zlib.crc32(b"w" + word.encode("utf-8", "replace")) % buckets]
    return out + [zlib.crc32(s[i : i + n].encode("utf-8", "replace")) % buckets for n in (3, 4) for i in range(len(s) - n + 1)]


class Words(dict):
    """word -> number; a word that is new gets the next one and its hash, and is made known in UTF-8."""

    def __init__(self, made=None):
        super().__init__()
        self.hashes, self.made = array("q"), made

    def __missing__(self, word: str) -> int:
        k = self[word] = len(self.hashes)
        x = word.encode("utf-8", "replace")
        self.hashes.append(zlib.crc32(x))
        if self.made:
            self.made(x)
        return k


def _byte_part(after: int) -> np.ndarray:
    """What each byte adds by exclusive or to the CRC of a text in which so many bytes follow it."""
    return np.array([zlib.crc32(bytes([b]) + bytes(after)) ^ zlib.crc32(bytes(1 + after)) for b in range(256)], np.uint32)


_PART, _OF3, _OF4 = [_byte_part(k) for k in range(4)], np.uint32(zlib.crc32(bytes(3))), np.uint32(zlib.crc32(bytes(4)))
_W = zlib.crc32(b"w")


def word_sums(words: list[bytes], weights: np.ndarray) -> np.ndarray:
    """For each word, of ASCII, the sum of the weights of word_features: all words' n-grams are hashed at once, as a CRC is the exclusive or of what its bytes add."""
    b = np.frombuffer(b"<" + b"><".join(words) + b">", np.uint8)
    end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 2)
    p0, p1, p2, p3 = (p[b] for p in _PART)
    buckets = np.uint32(weights.size)
    four, three = np.zeros(b.size), np.zeros(b.size)
    three[:-2] = weights[(p2[:-2] ^ p1[1:-1] ^ p0[2:] ^ _OF3) % buckets]
    four[:-3] = weights[(p3[:-3] ^ p2[1:-2] ^ p1[2:-1] ^ p0[3:] ^ _OF4) % buckets]
    for k in (1, 2):  # what begins there runs into the next word
        three[end - k] = four[end - k] = 0
    four[end - 3] = 0
    own = weights[np.fromiter((zlib.crc32(x, _W) for x in words), np.uint32, len(words)) % buckets]
    return np.add.reduceat(three + four, np.concatenate(([0], end[:-1]))) + own


def pair_buckets(h: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of adjacent pairs, from the words' hashes."""
    a, b = h[:-1].astype(np.uint64), h[1:].astype(np.uint64)
    mixed = (a * np.uint64(0x9E3779B97F4A7C15) ^ b * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(40)
    return np.where(a == b, _REPEAT, mixed.astype(np.int64)) % buckets


def document_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets and their shares (they sum to 1)."""
    words = (text or "").split()
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    ids = [np.array(x) for x in map(word_features, words)]
    h = np.array([zlib.crc32(w.encode("utf-8", "replace")) for w in words], np.int64)
    f, n = np.unique(np.concatenate([*ids, pair_buckets(h)]), return_counts=True)
    return f, (n / n.sum()).astype(np.float32)


def train(samples: list[tuple[str, int]], dim: int = DIM, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> tuple[np.ndarray, float]:
    """Stochastic gradient descent on (text, label): epochs passes, or more if that gives fewer than STEPS steps. Returns each bucket's weight in the logit of label 1, and the bias."""
    if not samples:
        return np.zeros(BUCKETS, np.float32), 0.0
    rng = np.random.default_rng(seed)
    epochs = max(epochs, -(-STEPS // len(samples)))
    docs = [(*document_features(t), int(y)) for t, y in samples]
    vectors = rng.uniform(-1 / dim, 1 / dim, (BUCKETS, dim)).astype(np.float32)
    out, bias = np.zeros((2, dim), np.float32), np.zeros(2, np.float32)
    steps, total = 0, epochs * len(docs)
    for _ in range(epochs):
        for k in rng.permutation(len(docs)):
            f, w, y = docs[k]
            r = rate * (1 - steps / total)
            steps += 1
            hidden = w @ vectors[f] if f.size else np.zeros(dim, np.float32)
            z = out @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1  # gradient of the logits
            back = p @ out
            out -= r * np.outer(p, hidden)
            bias -= r * 0.1 * p
            if f.size:
                vectors[f] -= (r * f.size * w)[:, None].clip(max=4 * r) * back[None, :]
    return (vectors @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0])


def sample_labels(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> list[tuple[str, int]]:
    """At most about sample_docs labelled texts, chosen by hash. The chosen ids are few by construction, so they are broadcast."""
    labels = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("l_id"), "quality")
    n = max(1, labels.count())
    rate = min(1 << 30, sample_docs * (1 << 30) // n + 1)
    chosen = labels.filter(F.pmod(F.xxhash64(F.lit("quality"), "l_id"), F.lit(1 << 30)) < rate)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("l_id")).select("text", "quality").collect()
    return sorted((t or "", q) for t, q in rows)


SCHEMA = "doc_id long, score double"


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """docs: doc_id, text. One row per document."""
    return docs.select("doc_id", "text").mapInPandas(_scorer(model), SCHEMA)


def _scorer(model: tuple[np.ndarray, float]):
    weights, bias = model

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one = Scorer(weights, bias)
        for b in batches:
            yield pd.DataFrame({"doc_id": b.doc_id.astype("Int64"), "score": [one(t) for t in b.text]})

    return run


def keep_good(docs: DataFrame, model: tuple[np.ndarray, float], threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose text scores at least threshold; all columns as they are."""
    weights, bias = model

    @F.pandas_udf("double")
    def scores(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = Scorer(weights, bias)
        for s in texts:
            yield pd.Series([one(t) for t in s], dtype=float)

    return docs.filter(scores("text") >= threshold)


class Scorer:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias
        self.clear()

    def clear(self) -> None:
        self.new: list[bytes] = []
        self.words, self.sums, self.sizes = Words(self.new.append), array("d"), array("q")

    def _learn(self) -> None:
        """Sums and numbers of features of the new words, in their order, so many at once."""
        for at in range(0, len(self.new), AT_ONCE):
            some = self.new[at : at + AT_ONCE]
            sums, sizes = np.zeros(len(some)), np.fromiter(map(len, some), np.int64, len(some)) * 2
            plain = [k for k, x in enumerate(some) if len(x) <= LONG and x.isascii()]
            if plain:
                sums[plain] = word_sums([some[k] for k in plain], self.weights)
            for k in set(range(len(some))).difference(plain):
                f = word_features(some[k].decode())
                sums[k], sizes[k] = self.weights[f].sum(dtype=np.float64), len(f)
            self.sums.frombytes(sums.tobytes())
            self.sizes.frombytes(sizes.tobytes())
        self.new.clear()

    def __call__(self, text: str | None) -> float:
        tokens = (text or "").split()
        z = self.bias
        if tokens:
            if len(self.words) > WORDS_KEPT:
                self.clear()
            k = np.fromiter(map(self.words.__getitem__, tokens), np.int64, len(tokens))
            self._learn()
            pairs = pair_buckets(np.frombuffer(self.words.hashes, np.int64)[k])
            total = np.frombuffer(self.sums)[k].sum() + self.weights[pairs].sum(dtype=np.float64)
            z += float(total) / float(np.frombuffer(self.sizes, np.int64)[k].sum() + pairs.size)
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def fit(docs: DataFrame, labels: DataFrame, fold: int = FOLD) -> tuple[np.ndarray, float]:
    """Learns from the labelled documents whose crc32(doc_id) mod fold isn't 0."""
    return train(sample_labels(docs, labels.filter(remainder("doc_id", fold) != 0)))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (remainder("doc_id", FOLD) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
