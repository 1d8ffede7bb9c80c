import gzip
import os
import random
import time

import brute
import corpus_pipeline
from pyspark.sql import functions as F

from arborlake.llm import decontam, neardup, warc

HTML = '<html><head><title>A &amp; B</title><script>x("</p>")</script><style>p{}</style></head><body><h1>Head</h1><p>One <b>two</b>&nbsp;three</p><a href="/x?a=1&amp;b=2">l</a><a href="/x?a=1&amp;b=2">again</a><a href="#f">f</a><img src=\'i.png\'><p>un<i>closed'


def test_derived_records_refer_to_their_source():
    source = warc.response_record("http://h.example/d/p", HTML)
    meta, text = warc.derive(source)
    head = source["headers"]
    for r in (meta, text):
        h = r["headers"]
        assert h["WARC-Refers-To"] == head["WARC-Record-ID"] != h["WARC-Record-ID"] and h["WARC-Source-Payload-Digest"] == head["WARC-Payload-Digest"] == warc.digest(HTML.encode())
        assert h["WARC-Block-Digest"] == warc.digest(r["block"]) and int(h["Content-Length"]) == len(r["block"]) and h["WARC-Refers-To-Target-URI"] == "http://h.example/d/p"
    assert text["block"].decode() == "Head\nOne two three\nlagainf\nunclosed"
    assert meta["block"].decode().split("\r\n")[:-1] == ["title: A & B", "source-header: HTTP/1.1 200 OK", "source-header: Content-Type: text/html; charset=utf-8", f"source-header: Content-Length: {len(HTML)}", "outlink: http://h.example/x?a=1&b=2 A/@href", "outlink: http://h.example/d/i.png IMG/@src"]
    assert warc.derive(source) == [meta, text]


def test_files_round_trip(spark, tmp_path):
    records = [r for h in (HTML, "", "é\r\n\r\nWARC/1.1") for s in [warc.response_record("http://h.example/", h)] for r in (s, *warc.derive(s))]
    data = b"".join(map(warc.to_bytes, records))
    assert list(warc.from_bytes(data)) == records == list(warc.from_bytes(b"".join(gzip.compress(warc.to_bytes(r)) for r in records)))
    (tmp_path / "a.warc").write_bytes(data)
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(warc.to_bytes(r)) for r in records))
    got = warc.read_warc(spark, str(tmp_path)).collect()
    for name in ("a.warc", "b.warc.gz"):
        assert [{"headers": dict(r.headers), "block": bytes(r.block)} for r in got if r.path.endswith(name)] == records


def test_derivatives_of_odd_pages(spark):
    rows = [(1, "http://a.example/", HTML), (2, None, None), (None, "::bad", "<<<>&#xFFFFFFF;<a href='http://[::1'>x"), (1, "http://a.example/", HTML), (3, "u", ""), (4, "u", "<![foo[x]]>"), (5, "u", "<p>long " * 200_000)]
    got = warc.derivatives(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("block", F.lit(1))).collect()
    assert len(got) == 2 * len(rows) and {r.record_type for r in got} == {"metadata", "conversion"}
    assert len({r.record_id for r in got if r.page_id == 1}) == 2
    assert warc.derivatives(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


PIECES = ["<![foo[x]]>", "<![ >", "<!", "<!--", "-->", "<![CDATA[", "]]>", "<!DOCTYPE html>", "<a href='", "<a ", "</", "</a>", "<p>", "'", '"', ">", "<", "&#x", "&amp", "&#xFFFFFFF;", "<script>", "</script>", "<style>", "<title>", "</title>", "<?php", "word ", "\n", "\0", "<svg/>", "<template>", "é", "<![endif]>", "<!ELEMENT", "[", "]"]


def test_any_markup_is_read():
    r = random.Random(1)
    for _ in range(5000):
        warc.read_html("".join(r.choices(PIECES, k=r.randint(1, 25))), "http://h.example/")
    assert warc.read_html("a<![foo[x]]>b<p>c", "")[1] == "ab\nc"
    assert warc.read_html("a &lt; b <a href=", "")[1] == "a < b <a href="
    assert warc.read_html("<!-- gone --><p>kept <!-- never ends <b>x</b> y", "")[1] == "kept <!-- never ends x y"


def test_long_markup_takes_time_in_proportion():
    for piece in ("<", "<!--", "<a ", "</", "<![", "&#x", "<a href='", "<p>x ", "<script>"):
        for end in ("", ">", "-->"):
            began = time.process_time()
            warc.read_html(piece * 30_000 + end, "http://h.example/")
            assert time.process_time() - began < 5, (piece, end)


def test_pipeline_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "decontaminate", "secrets", "mix"]
    columns, at = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        path = os.path.join(tmp_path, name)
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        at[name] = docs
        if name != "mix":
            assert docs.columns == columns
        if name == "near_duplicates":
            found = brute.components([(r.doc_id, r.text) for r in before.collect()])
            assert {r.doc_id for r in docs.collect()} == {i for i, (_, c) in found.items() if c == i}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r.doc_id for r in at["quality"].collect()}
    assert sum((i in kept) == bool(q) for i, q in labels.items()) / len(labels) > 0.95
    assert decontam.find_contaminated(at["decontaminate"], spark.read.parquet(f"{sf}/benchmark.parquet")).isEmpty()
    assert not any(brute.base_spans(r.text) for r in at["secrets"].collect())
    assert {r.doc_id for r in at["mix"].collect()} <= {r.doc_id for r in at["secrets"].collect()}
    assert "copy" in at["mix"].columns and neardup.near_duplicates(at["mix"].filter("copy = 1")).filter("NOT kept").isEmpty()
