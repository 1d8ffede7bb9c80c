"""Scoring by prediction by partial matching, and by smoothed word counts.

The model is a byte-context trie, pretrained on all learning documents: how often each byte follows
each context of 0 to ``ORDER`` bytes. A byte's probability comes from its longest known context;
where it doesn't occur there, the escape probability (method C: kinds seen / (count + kinds)) is paid
and the next shorter context is asked with the symbols already ruled out excluded, down to equal
shares of what is left. A document's score is the sum of log10 over its bytes and an end mark.

All n-grams are counted, those of the learning documents as the model and all as what will be asked;
partial counts are made where the texts are read and summed by one shuffle. Nothing is pruned: contexts
and what follows them are written tables that grow with the corpus (a context has at most 256
followers), and each distinct n-gram gets its probability once, by equi-joins with the contexts of each
order. The probabilities of the most frequent n-grams, ``RARE`` at most, are broadcast; a text's other
n-grams are joined. Which way one goes changes no result.

Word counts are joined, not broadcast, except for words that are at least one in ``RARE_WORD`` of all
(so at most that many).

Defined results: null text is empty; an empty text is the end mark alone; with nothing to learn from
every symbol has an equal share, and N and V are 0; a null doc_id counts as the empty text in crc32;
rows that repeat a doc_id are scored each by its own text; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake.llm.textops import lower_ascii, remainder, table, text_of, words
from arborlake.session import Scratch

ORDER, RARE, RARE_WORD, FOLD = 4, 1 << 20, 1 << 19, 10
FIRST, LAST, SYMBOLS = 0xFE, 0xFF, 257  # bytes that UTF-8 never has mark the start and the end
BATCH = 1 << 20
KEY = ["id", "row"]
_HASH, _BITS = np.uint64(0x9E3779B97F4A7C15), 8 * (ORDER + 1)


def _grams(texts: list[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Keys of order + 1 bytes, one for each byte and end mark, and where each text's keys begin."""
    parts, starts, n = [], [], 0
    pad, end = bytes([FIRST]) * order, bytes([LAST])
    for t in texts:
        parts += [pad, t.encode("utf-8", "surrogatepass"), end]
        starts.append(n)
        n += order + len(parts[-2]) + 1
    b = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint64)
    key = b[order:].copy()
    for k in range(1, order + 1):
        key |= b[order - k : b.size - k] << np.uint64(8 * k)
    begin = np.array(starts, np.int64)
    length = np.diff(np.append(begin, n)) - order
    at = np.repeat(begin - np.append(0, np.cumsum(length)[:-1]), length) + np.arange(length.sum())
    return key[at], np.append(0, np.cumsum(length)[:-1])


def _low(gram: Column, k: int) -> Column:
    """The last k bytes."""
    return gram.bitwiseAND(F.lit((1 << 8 * k) - 1))


def _batches(texts: Iterator[str]) -> Iterator[list[str]]:
    held, n = [], 0
    for t in texts:
        held.append(t)
        n += len(t)
        if n >= BATCH:
            yield held
            held, n = [], 0
    if held:
        yield held


def count_grams(docs: DataFrame) -> DataFrame:
    """docs: text, not null, and the boolean column learn. gram, n over the documents to learn from, m over all."""

    def merged(found: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        k, inv = np.unique(np.concatenate([x for x, _ in found]), return_inverse=True)
        return k, np.bincount(inv, np.concatenate([y for _, y in found]), minlength=k.size).astype(np.int64)

    def frames(keys: np.ndarray, counts: np.ndarray) -> Iterator[pd.DataFrame]:
        for a in range(0, keys.size, 100_000):
            yield pd.DataFrame({"gram": keys[a : a + 100_000].astype(np.int64), "n": counts[a : a + 100_000]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: list[tuple] = []
        for held, texts in ((h, x) for b in batches for h in (0, 1) for x in _batches(iter(b.text[b.learn != h]))):
            key = np.sort(_grams(texts)[0]) | np.uint64(held << _BITS)
            edge = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            found.append((key[edge], np.diff(np.append(edge, key.size))))
            if sum(k.size for k, _ in found[1:]) > 2 * BATCH:
                found = [merged(found)]
                if found[0][0].size > 4 * BATCH:
                    yield from frames(*found[0])
                    found = []
        if found:
            yield from frames(*merged(found))

    found = docs.select("text", "learn").mapInPandas(run, "gram long, n long")
    learnt = F.when(F.col("gram") < 1 << _BITS, F.col("n")).otherwise(0)
    return found.groupBy(_low(F.col("gram"), ORDER + 1).alias("gram")).agg(F.sum(learnt).alias("n"), F.sum("n").alias("m"))


class Trie:
    """The model in one process, for few n-grams: of each order, its n-grams with counts, and its contexts."""

    def __init__(self, orders: list[tuple[np.ndarray, np.ndarray]]):
        self.orders, self.order, self.grams, self.contexts = orders, len(orders) - 1, [], []
        for k, (keys, n) in enumerate(orders):
            ctx, at = np.unique(keys >> np.uint64(8), return_inverse=True)
            total = np.bincount(at, n, minlength=ctx.size)
            kinds = np.bincount(at, minlength=ctx.size).astype(np.float64)
            below = np.zeros(ctx.size)  # what the next shorter context counts of the symbols seen here
            if k:
                shorter = keys & np.uint64((1 << 8 * k) - 1)
                low_keys, low_n = self.grams[-1]
                below = np.bincount(at, low_n[self._find(low_keys, shorter)[0]], minlength=ctx.size)
            self.grams.append((keys, n.astype(np.float64)))
            self.contexts.append((ctx, total, kinds, below))
        self.table = None

    @staticmethod
    def _find(keys: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not keys.size:
            return np.zeros(of.size, np.int64), np.zeros(of.size, bool)
        at = np.minimum(np.searchsorted(keys, of), keys.size - 1)
        return at, keys[at] == of

    def log10(self, key: np.ndarray) -> np.ndarray:
        """log10 probability of each key's last byte after the others."""
        out, open_ = np.zeros(key.size), np.arange(key.size)
        total_above, kinds_above, asked = (np.zeros(key.size) for _ in range(3))
        for k in range(self.order, -1, -1):
            here = key[open_] & np.uint64((1 << 8 * (k + 1)) - 1)
            ctx, total, kinds, below = self.contexts[k]
            c, known = self._find(ctx, here >> np.uint64(8))
            if not ctx.size:
                continue
            t = total[c] - total_above[open_]  # counts of the excluded symbols go
            q = kinds[c] - kinds_above[open_]
            g, hit = self._find(self.grams[k][0], here)
            hit &= known
            with np.errstate(divide="ignore", invalid="ignore"):
                p = np.where(hit, self.grams[k][1][g] / (t + q), np.where(known & (q > 0), q / (t + q), 1.0))
            out[open_] += np.log10(p)
            total_above[open_] = np.where(known, below[c], 0.0)
            kinds_above[open_] = np.where(known, kinds[c], 0.0)
            asked[open_] = np.where(known, kinds[c], asked[open_])
            open_ = open_[~hit]
        out[open_] -= np.log10(np.maximum(1.0, SYMBOLS - asked[open_]))
        return out

    def score(self, texts: list[str]) -> np.ndarray:
        """log10 probability of each text. Those of the highest order are in a hash table."""
        if self.table is None:
            keys, n = self.grams[self.order]
            keys = keys[np.argsort(n, kind="stable")]  # of two in one slot the more frequent stays
            bits = max(10, int(keys.size * 4).bit_length())
            self.shift, size = np.uint64(64 - bits), 1 << bits
            self.table, self.value = np.full(size, np.uint64(0xFFFFFFFFFFFFFFFF)), np.zeros(size)
            slot = (keys * _HASH) >> self.shift
            self.table[slot] = keys
            good = self.table[slot] == keys
            self.value[slot[good]] = self.log10(keys[good])
        key, starts = _grams(texts, self.order)
        slot = (key * _HASH) >> self.shift
        got = self.value[slot]
        miss = np.flatnonzero(self.table[slot] != key)
        if miss.size:
            some, inv = np.unique(key[miss], return_inverse=True)
            got[miss] = self.log10(some)[inv]
        return np.add.reduceat(got, starts)


def _contexts(grams: DataFrame, *more: str) -> DataFrame:
    """grams: gram, n. ctx and its kids: byte s, n. Few, as a byte has 256 values."""
    return grams.groupBy(F.shiftright("gram", 8).alias("ctx")).agg(F.collect_list(F.struct(_low(F.col("gram"), 1).alias("s"), "n", *more)).alias("kids"))


def _counts(kids: Column) -> Column:
    return F.aggregate(kids, F.lit(0).cast("long"), lambda t, x: t + x.n)


def probabilities(grams: DataFrame, scratch: Scratch) -> DataFrame:
    """grams: gram, n, m. gram, m, lp: log10 of the probability of the last byte after the others, for all grams, learnt or not."""
    kids = F.filter("kids", lambda x: x.n > 0)
    top = scratch.save(_contexts(grams, "m").select("ctx", "kids", kids.alias("known")).withColumn("t", _counts(F.col("known"))), "contexts")
    each = top.select("ctx", "known", "t", F.size("known").alias("q"), F.explode("kids").alias("x")).withColumn("gram", F.shiftleft("ctx", 8).bitwiseOR(F.col("x.s")))
    learnt = each.filter("x.n > 0").select("gram", "x.m", F.log10(F.col("x.n") / (F.col("t") + F.col("q"))).alias("lp"))

    # a byte that its context doesn't know: escape, and ask the next shorter one without the symbols seen
    escape = F.when(F.col("q") > 0, F.log10(F.col("q") / (F.col("t") + F.col("q")))).otherwise(0.0)
    asked = each.filter("x.n = 0").select("gram", "x.m", escape.alias("lp"), F.transform("known", lambda x: x.s).alias("gone"), F.lit(False).alias("hit"))
    lower = grams.filter("n > 0")
    for k in range(ORDER - 1, -1, -1):
        lower = scratch.save(lower.groupBy(_low(F.col("gram"), k + 1).alias("gram")).agg(F.sum("n").alias("n")), f"grams-{k}")
        contexts = _contexts(lower)
        contexts = F.broadcast(contexts) if k < 2 else contexts  # at most 256 rows
        j = asked.withColumn("ctx", F.shiftright(_low(F.col("gram"), k + 1), 8)).join(contexts, "ctx", "left")
        j = j.withColumn("left", F.filter(F.coalesce("kids", F.array().cast("array<struct<s:bigint,n:bigint>>")), lambda x: ~F.array_contains("gone", x.s)))
        j = j.withColumn("t", _counts(F.col("left"))).withColumn("q", F.size("left"))
        j = j.withColumn("n", F.get(F.filter("left", lambda x: x.s == _low(F.col("gram"), 1)), F.lit(0))["n"])
        step = F.when(F.col("hit") | (F.col("q") == 0), 0.0).otherwise(F.log10(F.coalesce("n", "q") / (F.col("t") + F.col("q"))))
        asked = j.select("gram", "m", (F.col("lp") + step).alias("lp"), F.concat("gone", F.transform("left", lambda x: x.s)).alias("gone"), (F.col("hit") | F.col("n").isNotNull()).alias("hit"))
    rest = F.when(F.col("hit"), 0.0).otherwise(F.log10(F.greatest(F.lit(1), SYMBOLS - F.size("gone"))))
    return scratch.save(learnt.unionByName(asked.select("gram", "m", (F.col("lp") - rest).alias("lp"))), "probabilities")


def _least(p: DataFrame, most: int) -> int:
    """The smallest count that at most so many n-grams have or exceed."""
    total = p.agg(F.sum("m")).first()[0] or 0
    top = -(-total // most) + 1  # fewer than most n-grams have this count or more
    least = top
    seen = 0
    for m, n in sorted(p.groupBy(F.least("m", F.lit(top)).alias("m")).count().collect(), reverse=True):
        seen += n
        if seen > most:
            break
        least = m
    return least


class Frequent:
    """Log-probabilities of the broadcast n-grams, in a hash table, and in order where two share a slot."""

    def __init__(self, keys: np.ndarray, lp: np.ndarray):
        self.keys, self.lp = keys, lp
        bits = max(10, int(keys.size * 2).bit_length())
        self.shift = np.uint64(64 - bits)
        self.table, self.value = np.full(1 << bits, np.uint64(0xFFFFFFFFFFFFFFFF)), np.zeros(1 << bits)
        slot = (keys * _HASH) >> self.shift
        self.table[slot] = keys
        good = self.table[slot] == keys
        self.value[slot[good]] = lp[good]

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """Of each text: the sum over its n-grams that are here; the others; how often each occurs."""
        key, starts = _grams(texts)
        slot = (key * _HASH) >> self.shift
        got = self.value[slot]
        miss = np.flatnonzero(self.table[slot] != key)
        at, found = Trie._find(self.keys, key[miss])
        got[miss] = np.where(found, self.lp[at], 0.0) if self.keys.size else 0.0
        miss = miss[~found]
        doc = np.searchsorted(starts, miss, "right") - 1
        pair, times = np.unique(key[miss] | doc.astype(np.uint64) << np.uint64(_BITS), return_counts=True)
        cut = np.searchsorted(pair >> np.uint64(_BITS), np.arange(1, len(texts)))
        gram = (pair & np.uint64((1 << _BITS) - 1)).astype(np.int64)
        return np.add.reduceat(got, starts), np.split(gram, cut), np.split(times, cut)


def ppm_scores(docs: DataFrame, scratch: Scratch, keep: list[str], most: int = RARE) -> DataFrame:
    """docs: id, row, text, not null, the boolean column learn, and the columns of keep. Those and score."""
    grams = scratch.save(count_grams(docs), "grams")
    p = probabilities(grams, scratch)
    least = _least(p, most)
    frequent = p.filter(F.col("m") >= least).select("gram", "lp").toArrow()  # as columns; rows would fill the driver
    keys, lp = frequent["gram"].to_numpy().astype(np.uint64), frequent["lp"].to_numpy()
    order = np.argsort(keys)
    shared = docs.sparkSession.sparkContext.broadcast((keys[order], lp[order]))
    del frequent, keys, lp, order
    kinds = dict(docs.dtypes)
    keep = [*KEY, *keep]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Frequent(*shared.value)
        for b in batches:
            at = 0
            for texts in _batches(iter(b.text)):
                score, gram, times = model(texts)
                yield b[keep].iloc[at : at + len(texts)].assign(score=score, gram=gram, times=times)
                at += len(texts)

    schema = ", ".join(f"{c} {kinds[c]}" for c in keep) + ", score double, gram array<long>, times array<long>"
    parts = scratch.save(docs.select(*keep, "text").mapInPandas(run, schema), "parts")
    asked = parts.select(*KEY, F.posexplode(F.arrays_zip("gram", "times")).alias("at", "x")).select(*KEY, "at", "x.gram", "x.times")
    rare = asked.join(p.filter(F.col("m") < least).select("gram", "lp"), "gram")
    # rows that repeat id and text are summed together; each gets its share
    rest = rare.groupBy(*KEY).agg((F.sum(F.col("lp") * F.col("times")) / F.sum((F.col("at") == 0).cast("long"))).alias("rest"))
    return parts.join(rest, KEY, "left").select(*keep, (F.col("score") + F.coalesce("rest", F.lit(0.0))).alias("score"))


def tokens(docs: DataFrame, keep: list[str]) -> DataFrame:
    """A row per word; the end mark is the caller's."""
    return docs.select(*keep, F.explode(words(lower_ascii(F.col("text")))).alias("token"))


def word_scores(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """docs: id, row, text and the boolean column learn. One row for each id and row: n_tokens, n_known, train_tokens, base_score."""
    counts = scratch.save(tokens(docs.filter("learn"), []).groupBy("token").agg(F.count("*").alias("c")), "words")
    ends = docs.filter("learn").count()
    n_words, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    total, vocabulary = n_words + ends, kinds + (ends > 0)

    def logp(c):
        return F.log10((c + 0.1) / F.lit(total + 0.1 * (vocabulary + 1)))

    least = max(1, -(-n_words // RARE_WORD))
    common = F.broadcast(counts.filter(F.col("c") >= least).withColumnRenamed("token", "w"))
    known = tokens(docs, KEY).join(common, F.col("token") == F.col("w")).groupBy(*KEY).agg(F.count("*").alias("n"), F.count("*").alias("known"), F.sum(logp(F.col("c"))).alias("sum"), F.lit(0).cast("long").alias("copies"))
    rare = tokens(docs, KEY).join(common, F.col("token") == F.col("w"), "left_anti").join(counts.filter(F.col("c") < least), "token", "left")
    found = rare.groupBy(*KEY).agg(F.count("*").alias("n"), F.count("c").alias("known"), F.sum(logp(F.coalesce("c", F.lit(0)))).alias("sum"), F.lit(0).cast("long").alias("copies"))
    end = docs.select(*KEY, F.lit(1).cast("long").alias("n"), F.lit(int(ends > 0)).cast("long").alias("known"), logp(F.lit(ends)).alias("sum"), F.lit(1).cast("long").alias("copies"))
    # rows that repeat id and text were counted together; each gets its share
    each = known.unionByName(found).unionByName(end).groupBy(*KEY).agg(*[F.sum(c).alias(c) for c in ("n", "known", "sum", "copies")])
    n = F.col("copies")
    return each.select(*KEY, F.expr("n div copies").alias("n_tokens"), F.expr("known div copies").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (F.col("sum") / n).alias("base_score"))


def score_documents(docs: DataFrame, fold: int = FOLD, most: int = RARE) -> DataFrame:
    """docs: doc_id, text. Learns from the rows whose crc32(doc_id) mod fold isn't 0 and scores all. most: how many n-grams are broadcast."""
    scratch = Scratch(docs.sparkSession, "lm")
    held = remainder("doc_id", fold) == 0
    rows = docs.select("doc_id", text_of("text").alias("text"), held.alias("held_out"), (~held).alias("learn"))
    rows = rows.withColumn("row", F.xxhash64("text")).withColumn("id", F.coalesce("doc_id", F.lit(-(2**63))))
    ppm = ppm_scores(rows, scratch, ["doc_id", "held_out"], most)
    return ppm.join(word_scores(rows, scratch), KEY).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
