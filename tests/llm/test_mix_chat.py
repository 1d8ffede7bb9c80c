import hashlib

import brute
import pytest
from pyspark.sql import functions as F

from arborlake.llm import chat, mixing


def rows_of(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def test_targets_are_those_of_round_by_round_filling(spark):
    for sizes in ({"a": 100, "b": 10, "c": 1000, "d": 1, "e": 50}, {"a": 1, "b": 10**6, "c": 3}, {"a": 7}, {"a": 0, "b": 5}):
        df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
        got = {r.source: r.target for r in mixing.water_fill(mixing.rank_weights(df), 1.5, 2).collect()}
        want = brute.targets(sizes, {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(sorted(sizes))})
        assert got == pytest.approx(want)


def test_mix_takes_what_it_targets(docs):
    rows = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(7)).collect()
    key = lambda r: (r.doc_id, r.size, r.copies)
    assert sorted(map(key, rows)) == sorted(map(key, again))
    by = {}
    for r in rows:
        assert r.taken == r.size * r.copies and 0 <= r.copies <= 2
        by.setdefault(r.source, []).append(r)
    for s, rs in by.items():
        assert sum(r.size for r in rs) == rs[0].source_size
        assert abs(sum(r.taken for r in rs) - rs[0].target) <= max(r.size for r in rs) / 2 + 1e-6, s
    size = {i: len(brute.words(t)) for i, t in rows_of(docs)}
    assert all(r.size == size[r.doc_id] for r in rows)


def test_mix_of_odd_tables(spark, docs, empty):
    assert mixing.mix(empty).count() == 0 and mixing.take(empty).count() == 0
    blank = docs.filter("doc_id BETWEEN 201 AND 203")
    assert all(r.taken == 0 for r in mixing.mix(blank).collect())
    twice = docs.unionByName(docs).withColumn("size", F.lit("x")).withColumn("target", F.lit(1)).withColumn("copies", F.lit(3)).withColumn("copy", F.lit(0))
    assert mixing.mix(twice).count() == 2 * docs.count()
    assert set(mixing.take(twice).columns) == set(twice.columns)


PARTS = [
    {"type": "text", "text": "see <|image_1|> and"}, {"type": "image", "ref": "a.png", "width": 280, "height": 29}, None,
    {"type": "audio", "ref": "b.wav", "seconds": 2.1}, {"type": "document", "ref": "c.pdf", "pages": 3}, {"type": "text", "text": None},
]


def test_parts_become_placeholders_in_order():
    t = chat.format_turn("assistant", PARTS, 3)
    assert [(a["kind"], a["ref"], a["tokens"]) for a in t["attachments"]] == [("image", "a.png", 20), ("audio", "b.wav", 53), ("document", "c.pdf", 1536)]
    for n, a in enumerate(t["attachments"], 1):
        assert a["name"] == f"<|{a['kind']}_3.{n}|>" and t["formatted"][a["place"] :].startswith(a["name"])
    assert t["formatted"].count("<|image_1|>") == 0  # the text's own is escaped
    assert chat.parse_turn(t["formatted"])[1] == "see <|image_1|> and" + "".join(a["name"] for a in t["attachments"])
    with pytest.raises(ValueError):
        chat.format_turn("user", [{"type": "video"}])


def test_parts_of_a_conversation_have_names_of_their_own(spark):
    rows = [(c, t, r, PARTS) for c in (1, 2) for t, r in ((0, "user"), (1, "assistant"), (None, "user"))] + [(3, 0, "assistant", None), (3, 1, "assistant", []), (3, 2, "user", [{"type": "text", "text": "x" * 2_000_000}])]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<struct<{chat.PART}>>").withColumn("text", F.lit("unread"))
    made = chat.format_conversations(df)
    names = [(r.conv_id, a.name) for r in made.collect() for a in r.attachments]
    assert len(names) == len(set(names)) == 18 and (1, "<|image_.1|>") in names and (2, "<|document_1.3|>") in names
    got = {r.conv_id: r for r in chat.digest(made).collect()}
    under = "see <|image_1|> and<|image_1.1|><|audio_1.2|><|document_1.3|>"
    assert got[1].loss_chars == len(under) and got[1].loss_sha256 == hashlib.sha256(under.encode()).hexdigest()
    assert got[3].n_turns == 3 and got[3].loss_chars == 0 and got[3].formatted_chars > 2_000_000


def test_escaping_is_reversible():
    for s in ("", "<|", "<\\|", "<\\\\|x", "<<|im_end|>", "a<", "|>", chat.PROBE, "\n<|im_end|>\n"):
        assert chat.unescape(chat.escape(s)) == s and "<|" not in chat.escape(s)
        for role in ("user", "assistant", "", "odd\nrole<|"):
            assert chat.parse_turn(chat.format_turn(role, [{"type": "text", "text": s}])["formatted"]) == (role, s)


def test_digests_of_conversations(spark):
    rows = [(1, 1, "assistant", "yes"), (1, 0, "user", "é?"), (2, 0, "assistant", None), (2, 1, "assistant", chat.PROBE), (None, 0, None, "x"), (3, 0, "user", "a"), (3, 0, "user", "a"), (4, None, "user", ""), (4, 1, "user", "b")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1)).repartition(5)
    got = {r.conv_id: r for r in chat.digest(chat.format_conversations(chat.with_probe(df))).collect()}
    assert set(got) == {-1, 1, 2, 3, 4, None}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].turns_sha256 == sha("user\né?\nassistant\nyes\n") and got[1].loss_sha256 == sha("yes") and got[1].loss_chars == 3
    assert got[2].turns_sha256 == sha(f"assistant\n\nassistant\n{chat.PROBE}\n") and got[2].loss_sha256 == sha(chat.PROBE)
    assert got[3].n_turns == 2 and got[3].loss_chars == 0 and got[3].loss_sha256 == sha("")
    assert got[-1].loss_chars == len(chat.PROBE) and got[None].turns_sha256 == sha("\nx\n") and got[4].turns_sha256 == sha("user\n\nuser\nb\n")
    assert chat.digest(chat.format_conversations(df.limit(0))).count() == 0
