"""Secret scanning: fixed patterns, and character Markov models for the rest.

Two order-1 character models, one of random strings and one of ordinary identifiers, are trained
from labelled samples. A token that is long enough, mixes letters with digits or both cases, and lies
in no pattern's span is a secret if its mean log-likelihood ratio per character is above a threshold.

Every text is scanned whole, by itself; nothing is shuffled. The models are a table of 128 x 128
numbers. Training reads generated samples and, as further ordinary text, all words of a sample of
about ``SAMPLE_DOCS`` distinct texts chosen by a hash of text and doc_id.

What the models make of a base span is reported too (n_confirmed), but a base span stays whatever they say.

Defined results: null and empty texts have no spans; repeated rows are each scanned, and sampled as one; a null
doc_id is kept; an empty table gives no rows, and then generated samples are all that is learned; other columns
aren't read.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake.llm.textops import table

KINDS = ("assign", "access", "hex", "markov")
MIN_LENGTH, THRESHOLD, SAMPLE_DOCS, SEED = 20, 0.25, 400, 11
_ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # the runs of [0-9a-f]+ with 24 or more characters
_TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_LENGTH)
_PARTS = (
    "get set user name count value index list map node edge file path data text word line page item base cache token key store load save read write open close "
    "first last next prev start stop begin end size length width height offset limit total sum mean rank score sort filter group join merge split parse build "
    "make create delete update insert select query table column row field type class method function object string number integer float double boolean array "
    "config option setting default error warning info debug log trace message event handler listener request response client server session connection address "
    "port host http json xml html utf header body content version release build test case unit mock main run task job worker queue thread process memory buffer "
    "stream input output source target parent child root leaf tree graph model view controller service manager factory provider context state action reducer"
).split()


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Pattern matches as (start, end, kind), each kind leftmost and non-overlapping; too short ones are dropped."""
    out = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def labelled_samples(n: int = 4000, seed: int = SEED) -> list[tuple[str, int]]:
    """Random strings (1) over the usual alphabets, and identifiers (0) in the usual cases."""
    r = random.Random(seed)
    hexa, alnum = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    alphabets = (hexa, hexa.upper(), alnum, alnum + "+/", alnum + "-_", alnum[:26] + "234567", alnum[26:])
    out = []
    for _ in range(n):
        out.append(("".join(r.choices(r.choice(alphabets), k=r.randint(20, 48))), 1))
        w = r.choices(_PARTS, k=r.randint(2, 5))
        style = r.randrange(5)
        s = "_".join(w) if style == 0 else "-".join(w) if style == 1 else w[0] + "".join(x.title() for x in w[1:]) if style == 2 else "_".join(w).upper() if style == 3 else "/".join(w)
        out.append((s + (r.choice(("", "", "", "2", "_v1", "-2024", "01"))), 0))
    return out


def fit(samples: Iterable[tuple[str, int]], smooth: float = 0.5) -> np.ndarray:
    """Log-likelihood ratios, random over ordinary, of each character after each other (0: the start)."""
    n = np.full((2, 128, 128), 0.0)
    for s, label in samples:
        codes = [0, *(c for c in s.encode("ascii", "ignore"))]
        np.add.at(n[label], (codes[:-1], codes[1:]), 1)
    used = np.zeros(128, bool)
    used[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."]] = True
    n[:, :, used] += smooth
    p = n / np.maximum(n.sum(axis=2, keepdims=True), 1e-9)
    return np.where(used[None, :], np.log(np.maximum(p[1], 1e-12)) - np.log(np.maximum(p[0], 1e-12)), 0.0)


def ratio(token: str, model: np.ndarray) -> float:
    """Mean log-likelihood ratio per character of an ASCII token."""
    codes = np.frombuffer(b"\0" + token.encode("ascii"), np.uint8)
    return float(model[codes[:-1], codes[1:]].mean())


def mixed(token: str) -> bool:
    digit, lower, upper = (any(map(f, token)) for f in (str.isdigit, str.islower, str.isupper))
    return digit and (lower or upper) or lower and upper


def scan(text: str, model: np.ndarray, threshold: float = THRESHOLD) -> list[tuple[int, int, str]]:
    """Base spans and the model's, by start, then kind."""
    spans = base_spans(text)
    free, until = [], 0  # base spans by start, merged: a token overlaps one if its neighbour there does
    for a, b, _ in spans:
        if a >= until:
            free.append((a, b))
        else:
            free[-1] = (free[-1][0], max(until, b))
        until = max(until, b)
    starts = [a for a, _ in free]
    for m in _TOKEN.finditer(text):
        k = bisect_left(starts, m.end()) - 1  # the last that starts before the token's end
        if mixed(m[0]) and not (k >= 0 and free[k][1] > m.start()) and ratio(m[0], model) > threshold:
            spans.append((m.start(), m.end(), "markov"))
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def confirmed(text: str, spans: list[tuple[int, int, str]], model: np.ndarray, threshold: float = THRESHOLD) -> int:
    """How many base spans hold a token that the model, too, takes for a secret."""
    return sum(any(mixed(m[0]) and ratio(m[0], model) > threshold for m in _TOKEN.finditer(text, a, b)) for a, b, k in spans if k != "markov")


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> np.ndarray:
    """Generated samples and, as ordinary, the long words outside of base spans in a sample of about sample_docs texts."""
    n = max(1, docs.count())
    rate = min(10**6, sample_docs * 10**6 // n + 1)
    rows = docs.filter((F.pmod(F.xxhash64(F.lit(SEED), "text", "doc_id"), F.lit(10**6)) < rate) & F.col("text").isNotNull()).select("text").distinct()
    words: set[str] = set()
    for (text,) in rows.toLocalIterator():
        at = 0
        for a, b, _ in [*base_spans(text), (len(text), len(text), "")]:
            words.update(re.findall(r"[A-Za-z_-]{4,}", text[at:a]))
            at = max(at, b)
    return fit([*labelled_samples(), *((w, 0) for w in sorted(words))])


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, n_markov long, n_confirmed long, base_sha256 string, spans string"


def find_secrets(docs: DataFrame, model: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """docs: doc_id, text. One row per document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for d, t in zip(b.doc_id.array, b.text):
                spans = scan(t or "", model, threshold)
                n = [sum(k == x for _, _, k in spans) for x in KINDS]
                rows.append((d, *n, confirmed(t or "", spans, model, threshold), hashlib.sha256(joined([s for s in spans if s[2] != "markov"]).encode()).hexdigest(), joined(spans)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")]).astype({"doc_id": "Int64"})

    return docs.select("doc_id", "text").mapInPandas(run, SCHEMA)


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """Each span, overlapping ones as one, becomes [SECRET]."""
    out, at, until = [], 0, -1
    for a, b, _ in spans:
        if a >= until:
            out += [text[at:a], "[SECRET]"]
        at = until = max(until, b)
    return "".join([*out, text[at:]])


def redact_documents(docs: DataFrame, model: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """docs with every secret in text replaced; n_chars, if it is there, follows. Other columns stay as they are."""

    @F.pandas_udf("string")
    def clean(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield pd.Series([None if t is None else redact(t, x) if (x := scan(t, model, threshold)) else t for t in s], dtype=object)

    out = docs.withColumn("text", clean("text"))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return find_secrets(docs, train(docs))
