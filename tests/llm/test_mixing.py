from evidencia.llm import mixing as p7


def docs(spark, n=600):
    rows = [(i, "word " * (3 + i % 7), ["Crawl", " crawl", "card-x", "note", None][min(4, (i % 10) // 2 + (i % 97 == 0) * 4)], "t") for i in range(n)]
    return spark.createDataFrame(rows + [(9000, None, "note", ""), (9001, "", "note", "")], "doc_id long, text string, source string, tokens string")


def targets(spark):
    rows = [("m", "crawl", 0.5, 1), ("m", "card_x", 0.3, 2), ("m", "note", 0.2, 3), ("m", "absent", 0.0, 3), ("x", "note", 1.0, 4)]
    return spark.createDataFrame(rows, "mix_name string, source string, target_share double, max_repeats int")


def test_shares_and_caps(spark):
    mixed = p7.mix_sources(docs(spark), targets(spark))
    got = {(r["mix_name"], r["source"]): r for r in p7.shares(mixed, targets(spark)).collect()}
    assert len(got) == 5 and got["m", "absent"]["tokens"] == 0
    for (mix, source), r in got.items():
        if r["target_share"]:
            assert abs(r["share_reached"] - r["target_share"]) < 0.02, (mix, source)
    caps = {(r[0], r[1]): r[3] for r in targets(spark).collect()}
    rows = mixed.collect()
    assert all(1 <= r["repeats"] <= caps[r["mix_name"], r["source"]] for r in rows)
    assert len({(r["mix_name"], r["doc_id"]) for r in rows}) == len(rows)
    assert not {9000, 9001} & {r["doc_id"] for r in rows}
    assert [r["repeats"] for r in rows if r["mix_name"] == "x"].count(4) == len([r for r in rows if r["mix_name"] == "x"])


def test_threshold_equals_a_sort_by_hash(spark):
    mix = p7.Mix(bits=3, rounds=20)
    rows = [("s", (i * 7919) % 4096 << 50, i % 5 + 1) for i in range(300)]
    records = spark.createDataFrame(rows, "source string, hash long, tokens long")
    for rest in (0, 1, 57, 400, 10_000):
        wanted = spark.createDataFrame([("m", "s", rest)], "mix_name string, source string, rest long")
        below = p7.thresholds(records, wanted, mix).first()["below"]
        reached = sum(t for _, h, t in rows if h < below)
        total, sums = 0, [0]
        for _, _, t in sorted(rows, key=lambda r: r[1]):
            total += t
            sums.append(total)
        assert abs(reached - rest) == min(abs(s - rest) for s in sums)


def test_empty(spark):
    assert p7.mix_sources(docs(spark).limit(0), targets(spark)).count() == 0
    assert p7.mix_sources(docs(spark, 20), targets(spark).limit(0)).count() == 0
