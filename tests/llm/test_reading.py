import math
from collections import Counter

from evidencia.llm import reading as p8

EASY = "We make the pots. The work is hot. You can call us. It runs all day. The price is low. "
HARD = "Notwithstanding considerable thermal gradients encountered throughout, microstructural homogeneity nevertheless permits predictable relaxation of residual stresses provided stoichiometric deviations remain negligible. "


def docs(spark):
    rows = [(i, (EASY * (8 - i % 8) + HARD * (i % 8)) or None, "en" if i % 9 else "xx", 1.0) for i in range(160)]
    return spark.createDataFrame(rows + [(500, None, "en", 0.0), (501, "", "en", 0.0), (502, " \n12", None, 0.0), (503, EASY, None, 0.0), (503, EASY, None, 0.0)], "doc_id long, text string, lang string, coverage double")


def labels(spark):
    rows = [(i, "r", 1 + (i % 8) * 4 // 7 if i != 16 else 5, None) for i in range(0, 160, 2)] + [(1, "r", None, None), (999, "r", 3, None)]
    return spark.createDataFrame(rows, "doc_id long, rater string, level int, rated_at string")


def test_counts_and_ranks(spark):
    counts = {(r[0], r[1]): r[2] for r in p8.word_counts(docs(spark)).collect()}
    want = Counter(w for r in docs(spark).collect() if r["lang"] == "en" and r["text"] for w in p8.WORD.findall(r["text"].lower()))
    assert counts == {("en", w): n for w, n in want.items()}
    table = spark.createDataFrame([("en", w, n) for w, n in want.items()], "lang string, word string, n long")
    got = {r["word"]: r["rank"] for r in p8.ranked_vocabulary(table, 1000).collect()}
    assert got == {w: 1 + sum(m > n for m in want.values()) for w, n in want.items()}
    few = {r["word"] for r in p8.ranked_vocabulary(table, 5).collect()}
    assert len(few) <= 5 and all(want[a] > want[b] for a in few for b in set(want) - few)


def test_coverage_rank(spark):
    vocabulary = spark.createDataFrame([("en", w, i) for i, w in enumerate("the work is hot we make pots".split(), 1)], "lang string, word string, rank long")
    df = spark.createDataFrame([(1, "The work the work the pots. The end.")], "doc_id long, text string")
    r = p8.text_features(df, vocabulary, 0.5).first()
    assert r["coverage"] == math.log(1) and r["lang"] == "en" and r["sentence"] == math.log(8 / 2)
    assert p8.text_features(df, vocabulary, 0.75).first()["coverage"] == math.log(2)
    r = p8.text_features(df, vocabulary, 1.0).first()
    assert r["coverage"] is None and r["place"] == 1 and [tuple(x) for x in r["rest"]] == [("end", 1)]
    counts = spark.createDataFrame([("en", w, n) for w, n in {"the": 9, "work": 8, "pots": 3, "end": 2, "we": 2, "is": 1}.items()], "lang string, word string, n long")
    got = p8.far_coverage(p8.cut(p8.text_features(df, vocabulary, 1.0)), counts).first()
    assert got["coverage"] == math.log(4) and got.asDict().keys() == {"doc_id", "lang", *p8.FEATURES}


def test_a_small_vocabulary_changes_nothing(spark):
    """The ranks of words outside the collected vocabulary are exact: equal to an uncapped run, ties and all."""
    words = [f"{a}{b}sel" for a in "bcdfghklmn" for b in "aeiou"]
    rows = [(i, "the work is hot and we make it " * 4 + " ".join(words[(i * j) % 50] for j in range(1, 3 + i % 30)), "en", 0.0) for i in range(80)]
    df = spark.createDataFrame([*rows, (901, "the work is hot " + "unseen " * 30, "xx", 0.0)], "doc_id long, text string, lang string, coverage double")
    level = lambda size: {r["doc_id"]: r["estimate"] and round(r["estimate"], 9) for r in p8.reading_levels(df, labels(spark), size=size).collect()}
    all_, few = level(20_000), level(9)
    assert all_ == few and len(few) == 81
    counts = p8.cut(p8.word_counts(df))
    got = {r["doc_id"]: r["coverage"] for r in p8.far_coverage(p8.cut(p8.text_features(df, p8.ranked_vocabulary(counts, 9), 0.9)), counts).collect()}
    total = Counter(w for _, t, _, _ in rows for w in p8.WORD.findall(t))
    rank = lambda w: 1 + sum(m > total[w] for m in total.values())
    for i, t, _, _ in rows:
        ranks = sorted(map(rank, p8.WORD.findall(t)))
        assert math.isclose(got[i], math.log(ranks[math.ceil(0.9 * len(ranks)) - 1])), i


def test_a_text_of_no_known_language_is_unknown(spark):
    df = spark.createDataFrame([(i, EASY, "en") for i in range(9)] + [(99, "xqz wvv", None)], "doc_id long, text string, lang string")
    r = p8.reading_levels(df, labels(spark)).where("doc_id = 99").first()
    assert r["lang"] is None and r["estimate"] is None and r["level"] is None


def test_levels_follow_the_labels(spark):
    got = {r["doc_id"]: r for r in p8.reading_levels(docs(spark), labels(spark)).collect()}
    assert not {500, 501, 502} & set(got) and 503 in got
    assert all(abs(got[i]["estimate"] - (1 + (i % 8) * 4 / 7)) < 0.8 for i in range(160))
    assert got[16]["level"] <= 2  # one rater's slip


def test_no_labels_and_empty_tables(spark):
    none = labels(spark).limit(0)
    got = {r["doc_id"]: r["estimate"] for r in p8.reading_levels(docs(spark), none).collect()}
    assert got[7] > got[0]
    assert p8.reading_levels(docs(spark).limit(0), none).count() == 0
