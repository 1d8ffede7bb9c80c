"""Near duplicates, fingerprints and decontamination."""

import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from arborlake.llm import components, decontam, imatch, neardup
from arborlake.session import Scratch


def rows_of(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def groups(spark):
    """Dense groups of edited copies, a chain, and documents on their own."""
    r = random.Random(3)
    v = ["".join(r.choices("abcdefgh", k=5)) for _ in range(3000)]
    rows, n = [], 0

    def put(w):
        nonlocal n
        n += 1
        rows.append((n, " ".join(w)))

    for size in (40, 15, 5, 2, 2):
        base = r.choices(v, k=120)
        for _ in range(size):
            w = list(base)
            for _ in range(r.randint(0, 8)):
                w[r.randrange(len(w))] = r.choice(v)
            put(w)
    chain = r.choices(v, k=200)
    for _ in range(12):  # each is near the next, not the last but one
        put(chain)
        for k in range(18):
            chain[r.randrange(len(chain))] = r.choice(v)
    for _ in range(40):
        put(r.choices(v, k=r.randint(1, 90)))
    r.shuffle(rows)
    return spark.createDataFrame(rows, "doc_id long, text string")


# with tiny leaves the trees are deep, where a pair at the threshold survives less often: more trees make up for it
@pytest.mark.parametrize(("leaf", "trees", "block"), [(neardup.LEAF, neardup.TREES, neardup.BLOCK), (3, 96, 4)])
def test_near_duplicates_are_those_of_all_pairs(groups, leaf, trees, block):
    want = brute.components(rows_of(groups))
    got = neardup.near_duplicates(groups, leaf=leaf, trees=trees, block=block).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_of_odd_texts(spark, docs, empty):
    odd = docs.withColumn("n", F.lit("x")).withColumn("rep", F.lit(0)).withColumn("f1", F.lit(0))
    got = {r.doc_id: r for r in neardup.near_duplicates(odd).collect()}
    want = brute.components(rows_of(docs))
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert got[205].component_id == 204 and got[103].component_id == 6 and got[202].component_id == 202
    assert neardup.near_duplicates(empty).count() == 0
    twice = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b c"), (None, None), (2, "a b c")], "doc_id long, text string")
    rows = neardup.near_duplicates(twice).collect()
    assert len(rows) == 5 and sorted((r.doc_id or 0, r.component_id or 0) for r in rows) == [(0, 0), (0, 0), (1, 1), (1, 1), (2, 1)]
    kept = neardup.keep_one(twice.withColumn("lang", F.lit("en")))
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [(0, ""), (0, "a b c"), (1, "a b c")] and kept.columns == ["doc_id", "text", "lang"]


def test_rows_that_share_an_id_are_judged_by_their_own_text(spark):
    r = random.Random(6)
    a, b = ([f"{x}{k}" for k in range(60)] for x in "pq")
    near = lambda w: " ".join([*w[:-2], "other", "end"])
    rows = [(5, " ".join(a), 1), (5, " ".join(b), 2), (2, near(a), 3), (9, near(b), 4), (5, " ".join(b), 5), (5, None, 6), (5, "all on its own here", 7), (7, "", 8), (None, " ".join(a), 9)]
    r.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, k long")
    got = sorted((x.doc_id or 0, x.component_id or 0, x.kept) for x in neardup.near_duplicates(docs).collect())
    assert got == [(0, 0, True), (2, 2, True), (5, 2, False), (5, 5, True), (5, 5, True), (5, 5, True), (5, 5, True), (7, 7, True), (9, 5, False)]
    kept = neardup.keep_one(docs).collect()
    assert sorted(x.k for x in kept if x.k not in (2, 5)) == [3, 6, 7, 8, 9] and sum(x.k in (2, 5) for x in kept) == 1


def test_forests_find_what_a_large_dense_group_hides(spark):
    """A link at the threshold that shares no deep node of the first forest's trees is found in another's."""
    r = random.Random(9)
    base = [f"w{k}" for k in range(201)]
    rows = [(k, " ".join(w)) for k, w in enumerate([base[:p] + [f"x{k}"] + base[p + 1 :] for k, p in enumerate(r.choices(range(201), k=700))])]
    edge = list(base)
    for p in range(10, 130, 12):  # each word takes two shingles: 20 of 200
        edge[p] = f"y{p}"
    rows.append((10_000, " ".join(edge)))
    got = {x.doc_id: x.component_id for x in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), leaf=16).collect()}
    assert set(got.values()) == {0}


def test_components_of_long_chains(spark):
    edges = [(k, k + 1) for k in range(1, 60)] + [(100, 101), (7, 7)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.root for r in components.components(df, Scratch(spark, "t"), "x").collect()}
    assert got == {k: 1 for k in range(2, 61)} | {101: 100}
    assert components.components(df.limit(0), Scratch(spark, "t"), "x").count() == 0


def test_successors_wrap_around(spark):
    ids = [0, 1, 5, 65535, 65536, 70000, 2**40, -1, -(2**50), 2**62, -(2**63)]
    got = {r.id: r.next_id for r in imatch.successors(spark.createDataFrame([(i,) for i in ids], "id long")).collect()}
    s = sorted(ids)
    assert got == {a: b for a, b in zip(s, s[1:] + s[:1])}


def test_fingerprints(docs):
    df = docs.withColumn("h", F.lit(1)).withColumn("next", F.lit(2)).withColumn("id", F.lit(3))
    rows = {r.doc_id: r for r in imatch.fingerprints(df, most=20).collect()}
    text = dict(rows_of(docs))
    assert {i: r.edited_sha256 for i, r in rows.items()} == brute.edited(rows_of(docs))
    assert all(r.n_chars == len(text[i] or "") for i, r in rows.items())
    assert rows[6].fingerprint == rows[101].fingerprint == rows[103].fingerprint != rows[1].fingerprint
    assert rows[201].fingerprint == rows[202].fingerprint == rows[203].fingerprint
    long = [r for i, r in rows.items() if i < 61 and r.n_chars > 200]
    assert np.mean([r.near_edited for r in long]) > 0.2 > 0.05 > np.mean([r.near_next for r in long])
    assert all(0 <= x <= 1 for r in rows.values() for x in (r.near_edited, r.near_next))


def test_fingerprints_are_those_of_dictionaries(docs):
    rows = sorted(rows_of(docs))
    text = {i: t or "" for i, t in rows}
    f = brute.imatch([t for _, t in rows], 20, 4)
    got = {r.doc_id: r for r in imatch.fingerprints(docs, most=20).collect()}
    ids = [i for i, _ in rows]
    for i, after in zip(ids, ids[1:] + ids[:1]):
        t, cut = text[i], len(text[i]) // 4
        edited = t[: len(t) - cut] + text[after][:cut]
        assert got[i].fingerprint == brute.fingerprint_text(f(t)), i
        assert got[i].edited_fingerprint == brute.fingerprint_text(f(edited)), i
        assert got[i].near_edited == pytest.approx(brute.likeness(f(t), f(edited))) and got[i].near_next == pytest.approx(brute.likeness(f(t), f(text[after]))), i


def test_fingerprints_of_odd_tables(spark, empty):
    assert imatch.fingerprints(empty).count() == 0
    (one,) = imatch.fingerprints(spark.createDataFrame([(5, "abcdefgh")], "doc_id long, text string")).collect()
    assert one.edited_sha256 == brute.edited([(5, "abcdefgh")])[5] and one.near_next == 1
    rows = imatch.fingerprints(spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "x y z w"), (2, None)], "doc_id long, text string")).collect()
    assert len(rows) == 4 and sorted((r.doc_id or 0) for r in rows) == [0, 1, 1, 2]
    least = imatch.fingerprints(spark.createDataFrame([(imatch.FIRST_ID, "a b"), (None, "c d")], "doc_id long, text string")).collect()
    assert {r.doc_id for r in least} == {imatch.FIRST_ID, None}


def test_alignment_is_smith_waterman():
    r = random.Random(2)
    for _ in range(200):
        a, b = [r.choices(range(6), k=r.randint(0, 14)) for _ in range(2)]
        assert decontam.align(np.array(a, int), np.array(b, int)) == brute.smith_waterman(a, b)
    pairs = [[r.choices(range(4), k=r.randint(0, 20)) for _ in range(2)] for _ in range(300)]
    got = decontam.align_all(*[[np.array(p[k], np.int32) for p in pairs] for k in (0, 1)])
    assert got.tolist() == [brute.smith_waterman(a, b) for a, b in pairs]


def test_decontamination_finds_copies_edited_or_not(spark):
    r = random.Random(8)
    v = ["".join(r.choices("abcdefghijkl", k=r.randint(2, 6))) for _ in range(900)]
    items = [(k, " ".join(r.choices(v, k=r.randint(12, 40)))) for k in range(12)]
    rows, want = [], set()
    for i in range(150):
        w = r.choices(v, k=r.randint(20, 200))
        if i % 3 == 0:
            k = r.randrange(12)
            copy = items[k][1].split()
            for _ in range(len(copy) // 8):
                copy[r.randrange(len(copy))] = r.choice(v)
            if i % 2:
                copy.insert(r.randrange(len(copy)), "inserted")
            at = r.randrange(len(w))
            w[at:at] = [x.upper() + "," for x in copy]
            want.add((i, k))
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame([*rows, (900, None), (901, ""), (0, rows[0][1])], "doc_id long, text string").withColumn("h", F.lit(1)).withColumn("score", F.lit(1))
    bench = spark.createDataFrame([*items, (90, None), (91, "too short")], "item_id long, text string")
    got = decontam.find_contaminated(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    plain = lambda t: t.lower().replace(",", "").split()
    for g in got[:15]:
        item = plain(dict(items)[g.item_id])
        assert g.score <= brute.smith_waterman(item, plain(dict(rows)[g.doc_id])) / (2 * len(item)) + 1e-9
        assert g.score >= 0.5
    clean = decontam.keep_clean(docs, bench)
    assert {x.doc_id for x in clean.collect()} == {i for i, _ in rows} - {i for i, _ in want} | {900, 901} and clean.columns == docs.columns
    assert decontam.find_contaminated(docs.limit(0), bench).count() == 0 and decontam.find_contaminated(docs, bench.limit(0)).count() == 0


def test_decontamination_by_blocks_and_by_whole_short_items(spark):
    r = random.Random(4)
    v = ["".join(r.choices("abcdefghijkl", k=r.randint(2, 6))) for _ in range(500)]
    items = [(k, " ".join(r.choices(v, k=r.randint(3, 30)))) for k in range(20)] + [(50, "Yes."), (51, "not sure"), (None, "one two three four"), (52, "--")]
    rows = [(k, f"{' '.join(r.choices(v, k=9))} {t} {' '.join(r.choices(v, k=9))} {t.upper()}") for k, t in items[:20]]
    rows += [(60, "yes"), (61, "yes of course"), (62, " NOT, sure!"), (None, "one two three four"), (63, "One two -- three, four " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = {(x.doc_id, x.item_id): x.score for x in decontam.find_contaminated(docs, bench).collect()}
    assert set(whole) == {(k, k) for k in range(20)} | {(60, 50), (62, 51), (None, None), (63, None)}
    assert all(x == 1 for x in whole.values())
    parts = decontam.find_contaminated(docs, bench, block_words=40)
    assert {(x.doc_id, x.item_id): x.score for x in parts.collect()} == whole
    assert len(list(decontam.blocks(bench, 40))) > 3


def test_every_stretch_of_an_item_has_seeds_whatever_the_corpus():
    block = decontam.Block([(1, " ".join(f"w{k % 40}" for k in range(90))), (2, "a b c")])
    for scale in (1, 10**6):
        counts = np.arange(len(block.vocabulary) + 1) * scale
        hashes, item, place = block.seeds(counts)
        assert (np.diff(hashes.astype(object)) >= 0).all()
        assert all(((place[item == 0] // decontam.STRETCH) == k).sum() == decontam.LEAST for k in range(88 // decontam.STRETCH))
        assert place[item == 1].tolist() == [0]
