"""Plain Python versions of the operators, for small tables."""

import collections
import hashlib
import math
import re
import zlib

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def remainder(doc_id, mod):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % mod


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def targets(sizes, weights, share=1.5, epochs=2):
    """Round by round: clamp what is above its cap, share the rest by weight, until none is."""
    total, fixed = share * sum(sizes.values()), {}
    while True:
        free = [s for s in sizes if s not in fixed]
        if not free:
            return fixed
        level = (total - sum(fixed.values())) / sum(weights[s] for s in free)
        over = [s for s in free if weights[s] * level > epochs * sizes[s]]
        if not over:
            return fixed | {s: weights[s] * level for s in free}
        fixed |= {s: float(epochs * sizes[s]) for s in over}


def shingles(text):
    w = words(text)
    return set(zip(w, w[1:])) if len(w) > 1 else {tuple(w)} if w else set()


def components(rows, num=80, den=100):
    """rows: (doc_id, text). Every pair is compared."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and den * common >= num * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def base_scores(rows, fold=10):
    """rows: (doc_id, text)."""
    counts = collections.Counter()
    for i, t in rows:
        if remainder(i, fold):
            counts.update([*words(t), None])
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, t in rows:
        tokens = [*words(t), None]
        out.append((i, remainder(i, fold) == 0, len(tokens), sum(counts[x] > 0 for x in tokens), n, sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in tokens)))
    return out


class Ppm:
    """Byte contexts as dictionaries; escape C; exclusion by a set."""

    def __init__(self, texts, order, least=1):
        n = [collections.Counter() for _ in range(order + 1)]
        for t in texts:
            b = self.bytes(t, order)
            for p in range(order, len(b)):
                for k in range(order + 1):
                    n[k][b[p - k : p + 1]] += 1
        self.order, self.kids = order, [collections.defaultdict(dict) for _ in n]
        for k, c in enumerate(n):
            for g, x in c.items():
                if x >= least:
                    self.kids[k][g[:-1]][g[-1]] = x

    @staticmethod
    def bytes(text, order):
        return bytes([254]) * order + text.encode() + b"\xff"

    def p(self, context, symbol):
        out, gone = 1.0, set()
        for k in range(self.order, -1, -1):
            kids = self.kids[k].get(context[self.order - k :])
            if not kids:
                continue
            left = {s: n for s, n in kids.items() if s not in gone}
            total = sum(left.values())
            if symbol in left:
                return out * left[symbol] / (total + len(left))
            if left:
                out *= len(left) / (total + len(left))
            gone |= set(kids)
        return out / (257 - len(gone))

    def score(self, text):
        b = self.bytes(text, self.order)
        return sum(math.log10(self.p(b[i - self.order : i], b[i])) for i in range(self.order, len(b)))


def smith_waterman(a, b, match=2, mismatch=-1, gap=-1):
    h, best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)], 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (match if a[i - 1] == b[j - 1] else mismatch), h[i - 1][j] + gap, h[i][j - 1] + gap)
            best = max(best, h[i][j])
    return best


def edited(rows):
    """rows: (doc_id, text), ids distinct. Each edited text's digest."""
    rows = sorted(rows)
    out = {}
    for k, (i, t) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        c = len(t) // 4
        out[i] = hashlib.sha256((t[: len(t) - c] + after[:c]).encode()).hexdigest()
    return out


def base_spans(text):
    """The three patterns, written out."""
    found = []
    for kind, pattern, ok in (
        ("assign", re.compile(r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), lambda m: len(m[2]) >= 6),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
        ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
    ):
        found += [(m.start(), ("assign", "access", "hex").index(kind), m.end()) for m in pattern.finditer(text or "") if ok(m)]
    return [f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found)]


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def xx(value, seed=42):
    """Spark's xxhash64 of a text, a long, or (as a pair with its width) a smaller integer; seed: what came before it."""
    data = value.encode() if isinstance(value, str) else value.to_bytes(8, "little", signed=True) if isinstance(value, int) else value[0].to_bytes(value[1], "little", signed=True)
    return signed(xxhash.xxh64(data, seed=seed & (1 << 64) - 1).intdigest())


def imatch(texts, most, fewest, families=10, rates=6):
    """Each text's fingerprint: (hash, number of terms) of the whole, then of the subsets, None where one catches none. Lexicon of texts alone."""
    sets = [{xx(w) for w in words(t)} for t in texts]
    df = collections.Counter(t for s in sets for t in s)
    band = {t for t, n in df.items() if n * most >= len(texts) and n * fewest <= len(texts) and n > 1}

    def one(terms):
        h = 42
        for t in terms:
            h = xx(t, h)
        return h, len(terms)

    def fingerprint(text):
        every = {xx(w) for w in words(text)}
        kept = sorted(every & band or every)
        out = [one(kept)]
        for f in range(families):
            left = kept
            for r in range(1, rates + 1):
                left = [t for t in left if xx((f, 4), xx((r, 4), xx(t))) & 3 == 0]
                out.append(one(left) if left else None)
        return out

    return fingerprint


def likeness(a, b):
    pairs = [(x, y) for x, y in zip(a[1:], b[1:]) if x or y]
    if not pairs:
        return float(a[0][0] == b[0][0])
    weight = [1 / max(z[1] for z in p if z) for p in pairs]
    return sum(w for w, (x, y) in zip(weight, pairs) if x and y and x[0] == y[0]) / sum(weight)


def fingerprint_text(f):
    return ".".join(f"{x[0] & (1 << 64) - 1:x}:{x[1]}" if x else "-" for x in f)
