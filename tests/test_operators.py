"""Operators on small tables: order, ties, repeats, nulls, empty input, and any number of partitions."""

import datetime as dt
import random

from pyspark.sql import functions as F

from evidencia.operators import graph, ledger, matching, ordered, reports, signals


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_first_wins_is_the_same_in_any_partitioning(spark):
    data = [(k, o, f"v{o}") for k in "ab" for o in range(6)] + [(None, 1, "n"), ("a", 0, "v0")]
    for parts in (1, 5):
        random.Random(parts).shuffle(data)
        df = spark.createDataFrame(data, "k string, o int, v string").repartition(parts)
        want = [("a", 0, "v0"), ("b", 0, "v0"), (None, 1, "n")]
        assert rows(ordered.first_wins(df, [F.col("k")], [F.col("o"), F.col("v")])) == sorted(want, key=repr)
        assert rows(ordered.first_by(df, ["k"], ["o"], ["v"])) == sorted(want, key=repr)


def test_top_k_gives_duplicates_no_place(spark):
    df = spark.createDataFrame([("g", "a", 1), ("g", "a", 2), ("g", "b", 3), ("g", "c", 4)], "g string, k string, o int")
    assert rows(ordered.top_k(df, [F.col("g")], F.col("k"), [F.col("o")], 2).select("k", "o")) == [("a", 1), ("b", 3)]
    assert rows(ordered.top_k(df.limit(0), [F.col("g")], F.col("k"), [F.col("o")], 2)) == []


def test_fallback_takes_the_first_source_as_a_whole(spark):
    df = spark.createDataFrame([(1, 1, "x"), (1, 1, "y"), (1, 2, "z"), (2, 2, "w")], "g int, r int, v string")
    assert rows(ordered.fallback(df, ["g"], "r").select("g", "v")) == [(1, "x"), (1, "y"), (2, "w")]


def test_budgets(spark):
    df = spark.createDataFrame([(1, 1, 30), (1, 2, 30), (1, 3, 30), (2, 1, 100)], "g int, o int, n int")
    got = ordered.running_cap(df, ["g"], "o", F.col("n"), 70, 2)
    assert rows(got.select("g", "o", "kept")) == [(1, 1, 30), (1, 2, 30), (1, 3, 10), (2, 1, 70)]

    def loop(sizes, total, most):
        out = []
        for i, s in enumerate(sizes):
            out.append(min(s, most, total // (len(sizes) - i)))
            total -= out[-1]
        return out

    sizes = [5, 500, 40, 1000, 7]
    fold = ordered.fair_share(sizes, 600, 300)
    assert fold == loop(sizes, 600, 300)
    assert ordered.fair_share([], 600, 300) == []


def test_gaps_and_streaks(spark):
    t = dt.datetime(2026, 1, 1)
    df = spark.createDataFrame([("a", t), ("a", t + dt.timedelta(seconds=2)), ("a", t + dt.timedelta(hours=8)), ("b", t)], "k string, ts timestamp")
    assert rows(ordered.capped_gaps(df, ["k"], "ts", 30)) == [("a", 2_000_000), ("b", 0)]
    log = spark.createDataFrame([(1, "e"), (2, "e"), (3, "ok"), (4, "e")], "o int, x string").withColumn("k", F.lit(1))
    assert [r["streak"] for r in ordered.streaks(log, ["k"], ["o"], F.col("x") == "e").orderBy("o").collect()] == [1, 2, 0, 1]


def test_match_any_and_known_by(spark):
    left = spark.createDataFrame([(1, 9, "ann", "a@x"), (2, 9, "bob", None), (3, None, "ann", "a@x")], "id int, s int, n string, e string")
    right = spark.createDataFrame([(7, 9, "ann", "a@x"), (8, 9, "cid", "")], "id int, s int, n string, e string")
    keys = lambda d: matching.exploded_keys(d, F.col("id"), F.col("s"), {"name": F.array("n"), "email": F.array("e")})
    assert rows(matching.match_any(keys(left), keys(right))) == [(1, 7, ["email", "name"])]
    assert rows(matching.known_by(keys(left), keys(right))) == [(1, ["email", "name"], 1), (2, [], 0)]
    plan = matching.match_any(keys(left), keys(right))._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_only_match(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), ("b", 2)], "of string, to int")
    assert rows(matching.only_match(df, "of", "to")) == [("a", 1)]


def test_nearest_against_brute_force(spark):
    rng = random.Random(5)
    left = [(i, rng.randrange(3), rng.randrange(1000)) for i in range(60)]
    right = [(i, rng.randrange(3), rng.randrange(1000)) for i in range(60)]
    want = []
    for i, k, s in left:
        near = sorted((abs(s - t), t, j) for j, q, t in right if q == k and abs(s - t) <= 40)
        if near:
            want.append((i, near[0][0], near[0][2]))
    a, b = spark.createDataFrame(left, "i int, k int, s long"), spark.createDataFrame(right, "j int, k int, t long")
    assert rows(matching.nearest(a, b, ["k"], "s", "t", 40, "j").select("i", "distance", "j")) == sorted(want, key=repr)


def test_last_before_and_mentions(spark):
    df = spark.createDataFrame([(1, 1, "# A"), (1, 2, "x"), (1, 3, "# B"), (1, 4, "y"), (2, 1, "z")], "p int, n int, l string")
    got = matching.last_before(df, [F.col("p")], [F.col("n")], F.col("l").startswith("#"), F.col("l"), "h")
    assert [r["h"] for r in got.orderBy("p", "n").collect()] == ["# A", "# A", "# B", "# B", None]
    texts = spark.createDataFrame([(1, "the example works"), (1, "counterexample")], "k int, t string")
    phrases = spark.createDataFrame([(1, "example"), (1, "")], "k int, f string")
    assert rows(matching.mentions(texts, phrases, "k", "t", "f").select("t")) == [("the example works",)]


def test_attribution(spark):
    hits = spark.createDataFrame([(["a", "b"], "q", "u1"), (["a"], "q", "u2"), (["a"], "q", "u2"), ([], "q", "u3"), (None, "q", "u4"), (["a"], "q", None)], "e array<string>, q string, u string")
    got = rows(reports.attribution(hits, F.col("e"), F.col("q"), F.col("u")))
    assert got == [("a", 2, 2, 1), ("b", 1, 1, 0), ("unattributed", 2, 2, 2)]


def test_components_against_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(200, 230)] + [(5, 5), (None, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r[0]: r[1] for r in graph.connected_components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {x: find(x) for x in parent}
    assert graph.connected_components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_ledger(spark):
    t = dt.datetime(2026, 1, 1)
    df = spark.createDataFrame([("j1", "a", t, 1), ("j1", "a", t, 1), ("j1", "a", t + dt.timedelta(1), 2), ("j0", "b", t, 5), ("j9", None, t, 5)], "id string, k string, at timestamp_ntz, v int")
    assert rows(ledger.latest(df, "id", ["at"]).select("id", "v")) == [("j0", 5), ("j1", 2), ("j9", 5)]
    assert rows(ledger.first_claim(df, "k", "at", "id").select("k", "id")) == [("a", "j1"), ("b", "j0")]
    assert rows(ledger.stale(df, "id", "at", t + dt.timedelta(minutes=6), 5).select("id")) == [("j0",), ("j9",)]
    assert rows(ledger.keyset_page(df.select("v").distinct(), "v", 1, 1)) == [(2,)]


def test_signals_sections_links(spark):
    text = "# Top\nWrite to Info@a.test\n\n**Team**\nPat +1 202 555 0123, https://wa.me/12025550199 and https://de.linkedin.com/in/Pat-S?trk=1.\n[Site](https://a.test/x) ![i](https://a.test/i.png) [doc](https://a.test/i.png)"
    df = spark.createDataFrame([(1, "https://a.test/", text), (2, None, None), (3, "u", "")], "id int, url string, t string")
    got = rows(signals.signals(df, "id", "url", "t").select("channel", "value"))
    assert got == [("email", "info@a.test"), ("linkedin", "https://www.linkedin.com/in/pat-s"), ("phone", "+12025550123"), ("phone", "+12025550199"), ("whatsapp", "+12025550199")]
    assert signals.sections(df, "id", "t").count() == 2
    assert rows(signals.page_links(df, "id", "t").select("label", "href")) == [("Site", "https://a.test/x")]


def test_claims(spark):
    """The first reason that applies; cards veto what they don't hold whole."""
    from evidencia.operators import claims

    made = [
        (1, "Pat Sample", "email", "pat@a.test", "u", "observed"),
        (2, "Pat Sample", "email", "kim@a.test", "u", "observed"),
        (3, "Pat Sample", "phone", "+12025550123", "u", "observed"),
        (4, "Pat Sample", "email", "pat@a.test", "other", "observed"),
        (5, "Pat Sample", "email", "pat@a.test", None, "observed"),
        (6, "Pat Sample", "email", "two@a.test", "u", "observed"),
        (7, "Pat Sample", "email", "p.s@a.test", "u", "guessed"),
        (8, "Pat Sample", "linkedin", "https://x/in/p", "u", "observed"),
        (9, None, "email", "pat@a.test", "u", "observed"),
    ]
    c = spark.createDataFrame(made, "claim_id long, name string, channel string, value string, source string, status string")
    quotes = spark.createDataFrame([("u", "Sample, PAT? pat sample: pat@a.test, two@a.test p.s@a.test"), ("u", "Kim Other kim@a.test"), ("u", "pat sample +1 202 555-0123"), ("u", None)], "source string, text string")
    observed = spark.createDataFrame([("email", "pat@a.test", "u"), ("email", "kim@a.test", "u"), ("phone", "+12025550123", "u"), ("email", "two@a.test", "u")], "channel string, value string, source string")
    blocked = spark.createDataFrame([("email", "two@a.test")], "channel string, value string")
    fetched = spark.createDataFrame([("u",), ("u",)], "source string")
    got = {r["claim_id"]: r["verdict"] for r in claims.validated(c, observed, blocked, fetched, quotes).collect()}
    assert got == {1: "accepted", 2: "not bound", 3: "accepted", 4: "source not fetched", 5: "no source", 6: "conflicting", 7: "accepted", 8: "not observed", 9: "not bound"}
    cards = spark.createDataFrame([("u", "Pat Sample, buyer"), ("u", "Kim Other pat@a.test")], "source string, text string")
    vetoed = {r["claim_id"]: r["verdict"] for r in claims.validated(c, observed, blocked, fetched, quotes, cards).collect()}
    assert vetoed[1] == "not bound" and vetoed[4] == "source not fetched"
    assert claims.validated(c.limit(0), observed, blocked, fetched, quotes).count() == 0


def test_known_contacts_and_merging(spark):
    from evidencia.operators import claims

    people = spark.createDataFrame([(1, 7, "pat sample"), (2, 7, "kim other"), (3, 7, "lee new"), (4, 8, "pat sample")], "id long, scope long, name string")
    contacts = spark.createDataFrame([(1, 7, "email", "pat@a.test"), (1, 7, "phone", "1202"), (2, 7, "email", "kim@a.test"), (3, 7, "email", "lee@a.test"), (4, 8, "email", "pat@a.test")], "id long, scope long, channel string, key string")
    known = spark.createDataFrame([(7, "name", "pat sample"), (7, "email", "pat@a.test"), (7, "email", "kim@a.test"), (7, "email", None)], "scope long, channel string, key string")
    kept, fresh = claims.against_known(people, contacts, known)
    assert {r["id"]: r["matched_by"] for r in kept.collect()} == {1: "email,name", 3: "", 4: ""}
    assert sorted((r["id"], r["key"]) for r in fresh.collect()) == [(1, "1202"), (3, "lee@a.test"), (4, "pat@a.test")]
    rows = lambda xs: spark.createDataFrame(xs, "scope long, key string, verified boolean, id long")
    got = {r["key"]: (r["verified"], r["id"], r["sources"]) for r in claims.merged_people(rows([(1, "a", False, 1), (1, "b", True, 2)]), rows([(1, "a", True, 9), (1, "b", False, 8), (1, "c", False, 7), (1, None, True, 6)])).collect()}
    assert got == {"a": (True, 9, 2), "b": (True, 2, 2), "c": (False, 7, 1)}
    reach = spark.createDataFrame([(1, "x", "guessed"), (2, "y", "observed"), (3, " ", "observed")], "id long, value string, status string")
    who = spark.createDataFrame([(1, 5, "A", True, ""), (2, 5, "B", True, ""), (3, 5, "C", True, ""), (4, 5, "D", True, "")], "id long, g long, name string, verified boolean, matched_by string")
    assert [tuple(r) for r in claims.contactable(who, reach, "g").collect()] == [(5, 1, 2)]


def test_budgets_in_order(spark):
    from evidencia.operators import ordered

    df = spark.createDataFrame([(g, i, n) for g in ("a", None) for i, n in enumerate([5, 100, 3, 40, 7])] + [("a", 9, None)], "g string, i int, n long")
    got = {(r["g"], r["i"]): r["part"] for r in ordered.fair_share_rows(df, "g", "i", "n", 60, 30).collect()}
    want = ordered.fair_share([5, 100, 3, 40, 7], 60, 30)
    assert want == [5, 13, 3, 19, 7] and got == {(g, i): p for g in ("a", None) for i, p in enumerate(want)}
    rows = [("s", i, (i * 7) % 11) for i in range(40)]
    for width in (1, 7, 1000):
        used = 0
        out = {r["i"]: (r["used"], r["kept"]) for r in ordered.running_cap(spark.createDataFrame(rows, "g string, i long, n long"), ["g"], "i", F.col("n"), 100, width).collect()}
        for _, i, n in rows:
            used += n
            assert out[i] == (used, max(0, min(n, 100 - (used - n))))
