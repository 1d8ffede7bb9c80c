"""Language identification by rank-order n-gram profiles.

A profile is the ``TOP`` most frequent character n-grams (1 to 3, words padded) in order of rank. A
document takes the language whose profile has the least out-of-place distance: the sum, over the
document's own top n-grams, of how far each is from its rank there, ``TOP`` if it is absent.

Profiles are counted over a sample of at most about ``SAMPLE_DOCS`` documents a language, chosen by
hash; counting is distributed and only ``TOP`` rows a language reach the driver. Scoring reads each
whole text and shuffles nothing: a text is an array of code points, and its n-grams are integers of
21 bits a character, so that counting them is one sort.

Defined results: null text, or text without a letter, gives ``und`` and score 0; so does a table in
which no row has a language to learn; rows with a null lang are scored but not learned from; ties go to the
language that is first by name, ties in rank by a hash of the n-gram; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arborlake.llm.textops import remainder, small, table

TOP, SAMPLE_DOCS, FOLD = 300, 2500, 5
PAD, BITS = ord("_"), 21
_MIX = np.uint64(0x9E3779B97F4A7C15)
_LETTER = np.zeros(0, bool)


def _letters() -> np.ndarray:
    """For each code point, is it a letter?"""
    global _LETTER
    if not _LETTER.size:
        _LETTER = np.array([chr(c).isalpha() for c in range(0x110000)])
    return _LETTER


def grams(text: str) -> np.ndarray:
    """All n-grams of the words' letters: words in lower case, without what isn't a letter, padded by one _.

    A run of pads is one, which ends a word and begins the next; an n-gram that has it inside is no word's."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[c]
    space = np.isin(c, _SPACES)
    c = np.where(letter, c, PAD)[letter | space].astype(np.uint64)
    c = np.concatenate([[PAD], c, [PAD]]).astype(np.uint64)
    pad = c == PAD
    c = c[np.append(True, ~(pad[1:] & pad[:-1]))]
    if c.size < 3:
        return np.zeros(0, np.uint64)
    two = c[:-1] << np.uint64(BITS) | c[1:]
    three = two[:-1] << np.uint64(BITS) | c[2:]
    return np.concatenate([c[c != PAD], two, three[c[1:-1] != PAD]])


_SPACES = np.array([x for x in range(0x3001) if chr(x).isspace()], np.uint32)


def spell(gram: int) -> str:
    """An n-gram's characters."""
    out = ""
    while gram:
        out, gram = chr(gram & ((1 << BITS) - 1)) + out, gram >> BITS
    return out


def ranked(keys: np.ndarray, n: np.ndarray, k: int = TOP) -> np.ndarray:
    """The k most frequent keys, most frequent first; ties by a hash of the key."""
    order = (n.astype(np.int64) << np.int64(31)) - ((keys * _MIX) >> np.uint64(33)).astype(np.int64)
    if k < keys.size:
        best = np.argpartition(order, -k)[-k:]
        keys, order = keys[best], order[best]
    return keys[np.argsort(-order, kind="stable")]


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, top: int = TOP) -> dict[str, list[int]]:
    """docs: doc_id, text, lang. Profiles by language."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = known.groupBy("lang").agg(F.count("*").alias("n_lang"))
    draw = F.pmod(F.xxhash64(F.lit("langid"), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = known.select("doc_id", "lang", "text").join(small(sizes), "lang").filter(draw * F.col("n_lang") < sample_docs)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lang, texts in b.groupby("lang").text:
                key, n = np.unique(np.concatenate([grams(t) for t in texts]), return_counts=True)
                yield pd.DataFrame({"lang": lang, "gram": key.astype(np.int64), "n": n})

    totals = sample.select("lang", "text").mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), F.xxhash64("gram"), "gram"))
    out: dict[str, list[int]] = {}
    for lang, gram, _ in totals.select("lang", "gram", rank.alias("rank")).filter(F.col("rank") <= top).orderBy("lang", "rank").collect():
        out.setdefault(lang, []).append(gram)
    return out


class Scorer:
    def __init__(self, profiles: dict[str, list[int]], top: int = TOP):
        self.langs, self.top = sorted(profiles), top
        self.keys = np.array(sorted({g for p in profiles.values() for g in p}), np.uint64)
        self.ranks = np.full((len(self.langs), self.keys.size + 1), -1, np.int64)  # the last column: no profile has it
        for k, x in enumerate(self.langs):
            self.ranks[k, np.searchsorted(self.keys, np.array(profiles[x], np.uint64))] = np.arange(len(profiles[x]))

    def __call__(self, text: str | None) -> tuple[str, float]:
        key, n = np.unique(grams(text or ""), return_counts=True)
        if not key.size or not self.langs:
            return "und", 0.0
        best = ranked(key, n, self.top)
        at = np.searchsorted(self.keys, best)
        at[at == self.keys.size] = 0
        at = np.where(self.keys[at] == best, at, self.keys.size)
        r = self.ranks[:, at]
        far = np.where(r < 0, self.top, np.abs(r - np.arange(best.size))).sum(axis=1)
        k = int(far.argmin())
        return self.langs[k], 1.0 - float(far[k]) / (self.top * best.size)


SCHEMA = "doc_id long, lang_pred string, score double"


def identify(docs: DataFrame, profiles: dict[str, list[str]]) -> DataFrame:
    """docs: doc_id, text. One row per document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = Scorer(profiles)
        for b in batches:
            found = [score(t) for t in b.text]
            yield pd.DataFrame({"doc_id": b.doc_id.astype("Int64"), "lang_pred": [x for x, _ in found], "score": [y for _, y in found]})

    return docs.select("doc_id", "text").mapInPandas(run, SCHEMA)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = remainder("doc_id", FOLD) == 0
    return identify(docs, learn(docs.filter(~held))).withColumn("held_out", held).select("doc_id", "held_out", "lang_pred", "score")
