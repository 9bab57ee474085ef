"""Recorded responses, files, sinks and streams."""

import json

import pytest
from pyspark.sql import functions as F

from evidencia.sources import recorded, sinks
from evidencia.streaming import ledger as streams


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_search_results(spark):
    body = json.dumps({"results": [{"title": "a", "url": "https://a.test", "content": "x", "engines": ["e"]}, {"title": "b", "url": "https://[broken"}, *[{"title": str(i), "url": f"http://{i}.test"} for i in range(6)]], "unresponsive_engines": [["g", " timeout "], ["", "x"], ["h"]]})
    df = spark.createDataFrame([(1, body), (2, "no json"), (3, None)], "k int, b string")
    got = recorded.search_results(df, "k", "b", 5)
    assert rows(got.select("rank", "public")) == [(1, True), (3, True), (4, True), (5, True), (6, True), (7, False), (8, False)]
    assert rows(recorded.unresponsive(df, "k", "b")) == [(1, "g", "timeout")]


def test_markdown_results(spark):
    body = "intro\n### 1. First\n- **URL**: https://a.test/x\n- a snippet\n- more\n\n### 2. No address\n- text\n### 3. Third\n- **URL**: http://c.test\n"
    df = spark.createDataFrame([(1, body), (2, ""), (3, None)], "k int, b string")
    assert rows(recorded.markdown_results(df, "k", "b")) == [(1, 1, "First", "https://a.test/x", "a snippet"), (1, 3, "Third", "http://c.test", "")]


def test_sitemap(spark):
    xml = '<urlset xmlns="http://www.sitemaps.test/0.9"><url><loc> https://a.test/contact </loc></url><url><loc>ftp://x</loc></url><url><loc>https://a.test/contact</loc></url><url><loc>https://a.test/b</loc></url></urlset>'
    df = spark.createDataFrame([(1, xml)], "k int, x string")
    assert [r["url"] for r in recorded.sitemap_locations(df, "k", "x").orderBy("pos").collect()] == ["https://a.test/contact", "https://a.test/b"]


def test_first_json_object():
    assert recorded.first_json_object('noise {bad} then {"a": {"b": 1}} tail {"c": 2}') == '{"a":{"b":1}}'
    assert recorded.first_json_object("nothing {") is None and recorded.first_json_object(None) is None


def test_capped_text(spark):
    df = spark.createDataFrame([("d", 1, "aaaa"), ("d", 2, "bbbb"), ("d", 3, "cccc"), ("e", 1, "")], "d string, p int, t string")
    assert rows(recorded.capped_text(df, "d", "p", "t", 6)) == [("d", "[PDF page 1]\naaaa\n\n[PDF page 2]\nbb", 2), ("e", "[PDF page 1]\n", 1)]


def test_cards(spark):
    html = """<main><h2>Technical contacts</h2><article><h3>Pat Sample</h3><p>Production manager
    <a href="mailto:pat@example.test">pat (at) example.test</a> <a href="tel:+12025550123">+1 202 555 0123</a></p></article>
    <footer><div><h3>Office</h3><a href="mailto:info@example.test">info@example.test</a></div></footer>
    <div><h3>Other</h3><a href="mailto:b@example.test">a@example.test</a></div></main>"""
    df = spark.createDataFrame([(1, html), (2, None), (3, "<p><a href='mailto:x'>")], "k int, h string")
    got = {r["k"]: r for r in recorded.contact_cards(df, "k", "h").collect()}
    assert [c.split()[:2] for c in got[1]["cards"]] == [["Pat", "Sample"], ["Other", "a@example.test"]]
    assert [tuple(c) for c in got[1]["conflicts"]] == [("email", "a@example.test", "b@example.test")]
    assert got[2]["cards"] == [] and got[3]["cards"] == []


def test_export_and_results(spark, tmp_path):
    (tmp_path / "x.csv").write_text("﻿Name,Email\nPat,p@a.test\n", encoding="utf-8")
    assert rows(recorded.export_rows(spark, str(tmp_path / "x.csv"), ["Name", "Email"])) == [("Pat", "p@a.test")]
    try:
        recorded.export_rows(spark, str(tmp_path / "x.csv"), ["Phone"])
        raise AssertionError("no error")
    except ValueError as e:
        assert "Phone" in str(e)
    (tmp_path / "out/r1").mkdir(parents=True)
    (tmp_path / "out/r1/a.json").write_text('{"company": "c"}')
    (tmp_path / "out/r1/summary.json").write_text('{"company": "s"}')
    assert rows(recorded.result_files(spark, str(tmp_path / "out"), "company string", ["company"]).select("run", "company")) == [("r1", "c")]


def test_sinks(spark, tmp_path):
    a = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "k int, v string")
    sinks.write_tables({"a": a}, str(tmp_path), ["k"])
    assert spark.read.parquet(str(tmp_path / "a")).count() == 3
    got = {r[0]: json.loads(r[1]) for r in sinks.assembled({"a": a, "b": a.limit(0)}, "k").collect()}
    assert got == {1: {"a": [{"v": "x"}, {"v": "y"}]}, 2: {"a": [{"v": "z"}]}}
    assert rows(sinks.absent_only(a, spark.createDataFrame([(2,)], "k int"), ["k"], ["v"])) == [(1, "x")]
    assert sinks.inside("/out", "a/b.json") == "/out/a/b.json"
    with pytest.raises(ValueError):
        sinks.inside("/out", "../x")


def test_streams_equal_batches(spark, tmp_path):
    """Eight files in shuffled order of time over four triggers give the rows of the batch query."""
    from evidencia.operators import ordered

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    for i in range(8):
        events.where(f"pmod(xxhash64(event_id), 8) = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = streams.event_stream(spark, str(tmp_path / "in"), "*.parquet", late="3650 days", files=2)
    got = streams.run_available(streams.windowed_counts(stream, "ts", "event_type", "1 day"), "w", "update")
    assert got.selectExpr("sum(n)").first()[0] == events.count()
    want = rows(ordered.capped_gaps(events, ["user_id"], "ts", 3600))
    for _ in range(2):  # a second run doesn't go on from the first one's state
        stream = streams.event_stream(spark, str(tmp_path / "in"), "*.parquet", late="3650 days", files=2)
        assert rows(streams.run_available(streams.active_time(stream, "user_id", "ts", 3600), "t", "update")) == want


def test_late_events_settle(spark, tmp_path):
    import datetime as dt

    at = lambda m: dt.datetime(2026, 1, 1) + dt.timedelta(minutes=m)
    for i, minutes in enumerate([[0, 30], [10, 40], [20, 200], [210]]):
        spark.createDataFrame([(1, at(m)) for m in minutes], "user_id long, ts timestamp_ntz").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = streams.event_stream(spark, str(tmp_path / "in"), "*.parquet", late="60 minutes", files=1)
    got = streams.run_available(streams.active_time(stream, "user_id", "ts", 900), "late", "update")
    assert rows(got) == [(1, 50 * 60_000_000)]


def test_inputs_limits_and_keys(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"name": " ", "products": ["x"], "customs_search_enabled": True}))
    assert recorded.company_input(spark, str(tmp_path / "c.json")).first()["reason"] == "blank name"
    assert [recorded.clamped(n, 20) for n in (-1, 5, 99)] == [1, 5, 20]
    assert spark.range(1).select(recorded.redacted(F.lit("bad key abc in abc"), "abc", "")).first()[0] == "bad key *** in ***"
    df = spark.createDataFrame([("d", i, "x" if i != 2 else None) for i in range(1, 6)], "d string, p int, t string")
    assert recorded.capped_text(df, "d", "p", "t", 100, 3).first()["text"] == "[PDF page 1]\nx\n\n[PDF page 3]\nx\n\n[PDF page 4]\nx"


def test_recorded_provider(spark, tmp_path):
    from evidencia.sources import provider

    body = {"results": [{"title": "a", "url": "https://a.test", "content": "x", "engines": ["e"]}, {"title": "b", "url": "ftp://b"}, {"title": "c", "url": "http://c.test"}]}
    (tmp_path / "one.jsonl").write_text("\n".join(json.dumps(x) for x in [{"query": "q", "provider": "p", "body": body}, {"query": "r", "provider": "p", "body": "broken"}]) + "\nno json\n")
    spark.dataSource.register(provider.RecordedResponses)
    df = spark.read.format("recorded_responses").option("limit", "1").load(str(tmp_path))
    assert rows(df.select("query", "rank", "url", "public")) == [("q", 1, "https://a.test", True), ("q", 3, "http://c.test", False)]
    assert [h["url"] for h in provider.Recorded(str(tmp_path)).search("q", 5)] == ["https://a.test", "http://c.test"]
    provider.register(spark)
    got = spark.sql("select * from text_sections('a\n\n# b\nc')").collect()
    assert [tuple(r) for r in got] == [(0, "a"), (1, "# b\nc")]
