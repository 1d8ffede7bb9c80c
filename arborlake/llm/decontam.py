"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are runs of letters and digits in lower case. Word n-grams (``N`` words) of the benchmark items
are looked up in the training documents. Seeds are an item's rare n-grams: of every ``STRETCH``
successive ones the ``LEAST`` that are in fewest items and, were words independent, would be rarest
in the corpus. So every part of an item has seeds, as many for any size of the corpus, and a passage
that has leaked into very many documents stays findable, where its own document frequency would have
called it common. Around seed hits the passage that the item would cover is cut out, with slack;
hits that lie near each other share one passage. It is aligned with the item word by word; the score
is the best local alignment's over that of a perfect copy. Documents of ``SCORE`` or more are
contaminated. An item of fewer than ``N`` words has no n-gram: it is held against whole documents,
and found where those are the same words.

Scale: documents aren't shuffled. One pass splits the texts; it keeps, as numbers, the words of the
documents that have any n-gram of the benchmark, and counts the benchmark's words over all
documents. A second reads what was kept. What is broadcast is a block of items, of at most
``BLOCK_WORDS`` words or one item; a larger benchmark takes its blocks in turn. A passage is aligned
only if it has enough of the item's words; copies need none, and passages of an Arrow batch are
aligned together.

Defined results: null and empty texts have no passages, items without a word are never reported;
items that repeat are each reported; null ids are kept as they are, those of several rows as one;
rows that repeat a doc_id are reported once, with the best score; empty tables give no rows; other
columns aren't read.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake.llm.textops import table, without
from arborlake.session import Scratch

N, LEAST, STRETCH, SCORE, BLOCK_WORDS = 3, 2, 4, 0.5, 1_000_000
MATCH, MISMATCH, GAP = 2, -1, -1
CHUNK, CELLS = 1 << 18, 1 << 20
_WORD = re.compile(r"[^\W_]+")
_ASCII = str.maketrans({chr(c): " " for c in range(128) if not chr(c).isalnum()})
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def plain_words(text: str | None) -> list[str]:
    """Lower-case words: runs of letters and digits."""
    t = (text or "").lower()
    return t.translate(_ASCII).split() if t.isascii() else _WORD.findall(t)


def _grams(ids: np.ndarray) -> np.ndarray:
    """Hashes of the n-grams of word numbers; entry i begins at word i. Two that share a hash cost an alignment, no more."""
    a = ids.astype(np.uint64)
    n = max(0, a.size - N + 1)
    out = np.zeros(n, np.uint64)
    for k in range(N):
        out = (out ^ a[k : k + n]) * _MIX[k]
        out ^= out >> np.uint64(29)
    return out


def _among(of: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of these are in keys (sorted)."""
    if not keys.size:
        return np.zeros(of.size, bool)
    return keys[np.minimum(np.searchsorted(keys, of), keys.size - 1)] == of


class Block:
    """Some items as word numbers, from 1; 0 is any word of no item."""

    def __init__(self, items: list[tuple]):
        self.vocabulary: dict[str, int] = {}
        self.ids = [k for k, _ in items]
        self.words = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in plain_words(t)], np.int32) for _, t in items]
        found = [_grams(w) for w in self.words]
        self.grams = np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)
        self.short = defaultdict(list)
        for k, w in enumerate(self.words):
            if 0 < w.size < N:
                self.short[w.tobytes()].append(k)

    def seeds(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """counts: of each word number in the corpus. Seeds by hash: hash, item, place in the item."""
        log = np.log(np.maximum(1, counts)) - np.log(max(1, counts.sum()))
        grams = [_grams(w) for w in self.words]
        each, n_items = np.unique(np.concatenate([np.unique(g) for g in grams]) if grams else np.zeros(0, np.uint64), return_counts=True)
        out = []
        for k, (w, g) in enumerate(zip(self.words, grams)):
            expected = sum(log[w[i : i + g.size]] for i in range(N)) + np.log(n_items[np.searchsorted(each, g)])
            at = np.arange(g.size)
            order = np.lexsort((at, expected, at // STRETCH))
            first = np.searchsorted(at // STRETCH, at // STRETCH)  # where each stretch begins
            out += [(g[i], k, i) for i in order[at - first < LEAST]]
        out.sort()
        return np.array([x[0] for x in out], np.uint64), np.array([x[1] for x in out], np.int64), np.array([x[2] for x in out], np.int64)


KEPT = "doc_id long, words array<int>, word int, n long"
_KEPT = [c.split()[0] for c in KEPT.split(", ")]


def split_documents(docs: DataFrame, block: Block) -> DataFrame:
    """docs: doc_id, text. KEPT: the words, as numbers, of documents that have an n-gram of the block or are one of its short items; and counts of word numbers, by task."""
    sent = docs.sparkSession.sparkContext.broadcast((block.vocabulary, block.grams, set(block.short)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, grams, short = sent.value
        counts, number = np.zeros(len(vocabulary) + 1, np.int64), vocabulary.get

        def kept(ids: pa.Array, parts: list[np.ndarray]) -> pa.RecordBatch:
            """The documents that stay, after all are counted."""
            nonlocal counts
            size = np.array([p.size for p in parts])
            begin = np.append(0, np.cumsum(size))
            every = np.concatenate(parts)
            counts += np.bincount(every, minlength=counts.size)
            known = every > 0
            for k in range(1, N):
                known[:-k] &= every[k:] > 0
            place = np.flatnonzero(known[: max(0, every.size - N + 1)])
            doc = np.searchsorted(begin, place, "right") - 1
            inside = place + N <= begin[doc + 1]
            place, doc = place[inside], doc[inside]
            hit = np.zeros(len(parts), bool)
            hit[doc[_among(_hashes_at(every, place), grams)]] = True
            for k in np.flatnonzero(size < N) if short else ():
                hit[k] |= parts[k].tobytes() in short
            found = np.flatnonzero(hit)
            words = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size[found])), pa.int32()), pa.array(np.concatenate([every[:0], *(parts[k] for k in found)])))
            return pa.RecordBatch.from_arrays([ids.take(pa.array(found)), words, pa.nulls(found.size, pa.int32()), pa.nulls(found.size, pa.int64())], names=_KEPT)

        for b in batches:
            parts, n, begin = [], 0, 0
            for at, text in enumerate(b.column(1)):
                w = plain_words(text.as_py())
                parts.append(np.fromiter(map(number, w, repeat(0)), np.int32, len(w)))
                n += len(w)
                if n >= CHUNK or at == b.num_rows - 1:
                    yield kept(b.column(0).slice(begin, len(parts)), parts)
                    parts, n, begin = [], 0, at + 1
        word = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.nulls(word.size, pa.int64()), pa.nulls(word.size, pa.list_(pa.int32())), pa.array(word, pa.int32()), pa.array(counts[word], pa.int64())], names=_KEPT)

    return docs.select("doc_id", "text").mapInArrow(run, KEPT)


def _hashes_at(ids: np.ndarray, place: np.ndarray) -> np.ndarray:
    """_grams() at some places only."""
    out = np.zeros(place.size, np.uint64)
    for k in range(N):
        out = (out ^ ids[place + k].astype(np.uint64)) * _MIX[k]
        out ^= out >> np.uint64(29)
    return out


def align_all(items: list[np.ndarray], passages: list[np.ndarray]) -> np.ndarray:
    """Smith-Waterman scores of pairs of arrays of numbers (none of them negative), all pairs one row at a time.

    Within a row, gaps run to the right: best[j] = max(cell[i] + GAP * (j - i), i <= j), a running maximum."""
    best = np.zeros(len(items), np.int64)
    order = sorted(range(len(items)), key=lambda k: (passages[k].size, items[k].size))
    while order:
        width = passages[order[-1]].size
        some = order[-max(1, CELLS // max(1, width)) :]  # as many of the longest as fit
        del order[-len(some) :]
        if not width:
            continue
        a = np.full((len(some), max(items[k].size for k in some)), -1, np.int32)
        b = np.full((len(some), width), -2, np.int32)  # what pads matches nothing, so it only lowers scores
        for r, k in enumerate(some):
            a[r, : items[k].size], b[r, : passages[k].size] = items[k], passages[k]
        slope = np.arange(width, dtype=np.int32) * -GAP
        row, top = np.zeros(b.shape, np.int32), np.zeros(len(some), np.int32)
        for i in range(a.shape[1]):
            cell = np.where(b == a[:, i, None], np.int32(MATCH), np.int32(MISMATCH))
            cell[:, 1:] += row[:, :-1]
            np.maximum(cell, row + GAP, out=cell)
            np.maximum(cell, 0, out=cell)
            row = np.maximum.accumulate(cell + slope, axis=1) - slope
            np.maximum(top, row.max(axis=1), out=top)
        best[some] = top
    return best


def align(item: np.ndarray, passage: np.ndarray) -> int:
    return int(align_all([item], [passage])[0])


SCORED = "doc_id long, item_id long, score double, n_seeds long"


def search(kept: DataFrame, block: Block, counts: np.ndarray, least_score: float) -> DataFrame:
    """kept: doc_id, words. SCORED: the pairs of a document and an item of the block."""
    sent = kept.sparkSession.sparkContext.broadcast((block.ids, block.words, dict(block.short), *block.seeds(counts)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item_ids, items, short, keys, item_of, place_of = sent.value
        slack_of = np.array([w.size // 4 + 4 for w in items], np.int64)
        length_of = np.array([w.size for w in items], np.int64)
        for b in batches:
            out, open_ = [], []  # open_: document, item, seeds, passage
            for d, words in enumerate(b.column(1)):
                words = words.values.to_numpy(zero_copy_only=False)
                if words.size < N:
                    out += [(d, k, 1.0, 1) for k in short.get(words.tobytes(), ())]
                    continue
                g = _grams(words)
                pos = np.flatnonzero(_among(g, keys))
                lo, hi = np.searchsorted(keys, g[pos]), np.searchsorted(keys, g[pos], "right")
                pos = np.repeat(pos, hi - lo)
                seed = np.arange(pos.size) + np.repeat(lo - (np.cumsum(hi - lo) - (hi - lo)), hi - lo)
                item, shift = item_of[seed], pos - place_of[seed]
                order = np.lexsort((shift, item))
                item, shift = item[order], shift[order]
                edge = np.flatnonzero(np.append(True, (item[1:] != item[:-1]) | (np.diff(shift) > slack_of[item[1:]]))) if item.size else item
                for begin, end in zip(edge, np.append(edge[1:], item.size)):
                    k, size = item[begin], length_of[item[begin]]
                    if any(x >= 0 and np.array_equal(words[x : x + size], items[k]) for x in np.unique(shift[begin:end])):
                        out.append((d, k, 1.0, end - begin))
                        continue
                    passage = words[max(0, shift[begin] - slack_of[k]) : shift[end - 1] + size + slack_of[k]]
                    if np.isin(items[k], passage).sum() >= least_score * size:  # its score can't be higher
                        open_.append((d, k, end - begin, passage))
            score = align_all([items[k] for _, k, _, _ in open_], [p for *_, p in open_])
            out += [(d, k, s / (MATCH * length_of[k]), n) for (d, k, n, _), s in zip(open_, score) if s >= least_score * MATCH * length_of[k]]
            doc, item, score, n = zip(*out) if out else ((), (), (), ())
            columns = [b.column(0).take(pa.array(doc, pa.int64())), pa.array([item_ids[k] for k in item], pa.int64()), pa.array(score, pa.float64()), pa.array(n, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SCORED.split(", ")])

    return kept.select("doc_id", "words").mapInArrow(run, SCORED)


def blocks(benchmark: DataFrame, most: int = BLOCK_WORDS) -> Iterator[Block]:
    """benchmark: item_id, text. Its items in blocks of at most so many words, or one item."""
    held, n = [], 0
    for item, text in benchmark.select("item_id", "text").toLocalIterator():
        size = len(plain_words(text))
        if held and n + size > most:
            yield Block(held)
            held, n = [], 0
        if size:
            held.append((item, text))
            n += size
    if held:
        yield Block(held)


def find_contaminated(docs: DataFrame, benchmark: DataFrame, least_score: float = SCORE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs: doc_id, text; benchmark: item_id, text. doc_id, item_id, score, n_seeds of the contaminated pairs."""
    scratch = Scratch(docs.sparkSession, "decontam")
    found = docs.sparkSession.createDataFrame([], SCORED)
    for k, block in enumerate(blocks(benchmark, block_words)):
        kept = scratch.save(split_documents(docs, block), f"kept-{k}")
        counts = np.zeros(len(block.vocabulary) + 1, np.int64)
        for word, n in kept.filter("word IS NOT NULL").groupBy("word").agg(F.sum("n")).collect():  # a row for each word of the block at most
            counts[word] = n
        found = found.unionByName(search(kept.filter("words IS NOT NULL"), block, counts, least_score))
    return found.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"), F.sum("n_seeds").alias("n_seeds"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, least_score: float = SCORE) -> DataFrame:
    """The rows of docs that hold no item of the benchmark; all columns as they are."""
    return without(docs, Scratch(docs.sparkSession, "leaks").save(find_contaminated(docs, benchmark, least_score).select("doc_id"), "leaks"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
