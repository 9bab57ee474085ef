"""Problem 8: the reading level of each document.

How demanding a text's words are is the size of the smallest vocabulary, taken from the most frequent word of its
language downwards, that covers a fixed share of its words: its coverage rank. Coverage rank and the complexity of its
sentences are calibrated in SQL against the levels people gave to a sample.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import col, cut
from .language import label_language

WORD = re.compile(r"[^\W\d_]+")
#: Sentences end at their marks; items and lines of their own count as sentences too.
SENTENCE = re.compile(r"[.!?…;]+(?:\s|$)|\n")
TWO_WORDS = re.compile(r"[^\W\d_]+[\W\d_]+[^\W\d_]")
REST = pa.list_(pa.struct([("word", pa.string()), ("m", pa.int64())]))
FEATURES = ("coverage", "sentence", "word", "long")


def word_counts(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, word, n): how often each word stands in all texts labelled with each language.

    Every text counts in whole. Words are counted within a batch before anything is shuffled.
    """
    source = df.select(label_language(col(df, lang)).alias("lang"), col(df, text).cast("string").alias("text")).where("lang is not null and text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        size = 0
        for batch in batches:
            for label, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts.setdefault(label, Counter()).update(WORD.findall(body.lower()))
            size = sum(map(len, counts.values()))
            if size > 200_000:
                yield _counted(counts)
                counts = {}
        if counts:
            yield _counted(counts)

    return source.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _counted(counts: dict[str, Counter]) -> pa.RecordBatch:
    rows = [(k, w, n) for k, c in counts.items() for w, n in c.items()]
    a, b, c = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(c, pa.int64())], names=["lang", "word", "n"])


def ranks_by_count(counts: DataFrame) -> DataFrame:
    """(lang, n, rank, upto): the rank of the words that stand n times in a language, and how many stand as often or more.

    A word's rank is one more than the number of words counted more often: a histogram of counts gives it, no sort of
    all words. A language of t words has fewer than sqrt(2 t) different counts.
    """
    histogram = counts.groupBy("lang", "n").agg(F.count("*").alias("words"))
    upto = F.sum("words").over(Window.partitionBy("lang").orderBy(F.desc("n")))
    return histogram.select("lang", "n", "words", upto.alias("upto")).select("lang", "n", (F.col("upto") - F.col("words") + 1).alias("rank"), "upto")


def ranked_vocabulary(counts: DataFrame, size: int) -> DataFrame:
    """(lang, word, rank) of at most `size` words of each language; words counted equally often share a rank.

    Equal counts are left out together if they don't fit: they and all rarer words are ranked by `far_coverage`.
    """
    return counts.join(ranks_by_count(counts).where(F.col("upto") <= size), ["lang", "n"]).select("lang", "word", "rank")


def text_features(df: DataFrame, vocabulary: DataFrame, share: float = 0.8, head: int = 400, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang, coverage, sentence, word, long, rest, place) for each text with words.

    The language is the one whose `head` most frequent words fit most of the text's words, whatever its label says;
    null where none fits. coverage: log of the coverage rank; sentence: log of words per sentence; word: letters per
    word; long: share of words of nine letters and more. The vocabulary is collected: it holds at most `size` words of
    each language. Where the covering vocabulary goes beyond it, coverage is null, rest holds the words outside with
    their numbers, and place which of them, from the most frequent on, completes the share.
    """
    known: dict[str, dict[str, int]] = {}
    for row in vocabulary.collect():
        known.setdefault(row["lang"], {})[row["word"]] = row["rank"]
    votes: dict[str, dict[str, float]] = {}
    for lang, ranks in known.items():
        for w in sorted(ranks, key=lambda w: (ranks[w], w))[:head]:
            votes.setdefault(w, {})[lang] = 1.0
    votes = {w: {k: 1 / len(v) for k in v} for w, v in votes.items()}
    shared = df.sparkSession.sparkContext.broadcast((known, votes))
    source = df.select(col(df, key).alias("key"), col(df, text).cast("string").alias("text")).where("text is not null")
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, votes = shared.value
        nowhere = 2**62
        for batch in batches:
            keep, langs, values, rests, places = [], [], [], [], []
            for i, body in enumerate(batch.column(1).to_pylist()):
                words = WORD.findall(body.lower())
                if not words:
                    continue
                counted = Counter(words)
                score: dict[str, float] = {}
                for w, m in counted.items():
                    for k, v in votes.get(w, {}).items():
                        score[k] = score.get(k, 0.0) + v * m
                lang = max(score, key=lambda k: (score[k], k)) if score else None
                ranks = known.get(lang, {})
                n, place, rest, coverage = len(words), 0, [], None
                if lang is not None:
                    of = np.fromiter((ranks.get(w, nowhere) for w in counted), np.int64, len(counted))
                    times = np.fromiter(counted.values(), np.int64, len(counted))
                    order = np.argsort(of, kind="stable")
                    upto = np.cumsum(times[order])
                    wanted = max(1, int(np.ceil(share * n)))
                    at = of[order[np.searchsorted(upto, wanted)]]
                    if at < nowhere:
                        coverage = float(np.log(at))
                    else:
                        place = wanted - int(times[of < nowhere].sum())
                        rest = [{"word": w, "m": m} for w, m in counted.items() if w not in ranks]
                lengths = np.fromiter(map(len, counted), np.int64, len(counted))
                times = np.fromiter(counted.values(), np.int64, len(counted))
                sentences = sum(1 for s in SENTENCE.split(body) if len(s) > 3 and TWO_WORDS.search(s))
                keep.append(i)
                langs.append(lang)
                rests.append(rest)
                places.append(place)
                values.append((coverage, float(np.log(n / max(1, sentences))), float((lengths * times).sum() / n), float(times[lengths >= 9].sum() / n)))
            columns = [pa.array([v[k] for v in values], pa.float64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array(langs, pa.string()), *columns, pa.array(rests, REST), pa.array(places, pa.int64())], names=[key, "lang", *FEATURES, "rest", "place"])

    return source.mapInArrow(run, f"`{key}` {kind}, lang string, " + ", ".join(f"{f} double" for f in FEATURES) + ", rest array<struct<word:string,m:bigint>>, place long")


def far_coverage(found: DataFrame, counts: DataFrame) -> DataFrame:
    """`text_features` with the coverage of texts that need words outside the collected vocabulary, exactly ranked.

    Only those texts' rest words are joined with the counts, by a shuffle. Words that stand in no text of the language
    come after all that do.
    """
    numbered = found.withColumn("__row", F.monotonically_increasing_id())  # found is a table already: numbers stay
    each = numbered.where("place > 0").select("__row", "lang", "place", F.explode("rest").alias("x")).select("__row", "lang", "place", "x.word", "x.m")
    ranks = ranks_by_count(counts)
    last = ranks.groupBy("lang").agg((F.max("upto") + 1).alias("last"))
    ranked = each.join(counts, ["lang", "word"], "left").join(ranks.select("lang", "n", "rank"), ["lang", "n"], "left").join(last, "lang", "left").withColumn("rank", F.coalesce("rank", "last"))
    # one rank's words count together: the first rank at which enough of them have come
    by_rank = ranked.groupBy("__row", "place", "rank").agg(F.sum("m").alias("m"))
    come = F.sum("m").over(Window.partitionBy("__row").orderBy("rank"))
    far = by_rank.withColumn("come", come).where("come >= place").groupBy("__row").agg(F.log(F.min("rank").cast("double")).alias("__far"))
    return numbered.join(far, "__row", "left").withColumn("coverage", F.coalesce("coverage", "__far")).drop("__row", "__far", "rest", "place")


def calibrate(scaled: DataFrame, labels: DataFrame, key: str = "doc_id", level: str = "level", far: float = 1.2, ridge: float = 0.5) -> list[float]:
    """Intercept and weights of the scaled features: least squares over all labelled texts, by sums in SQL.

    A text's label is the mean of its raters. A second pass leaves out labels further than `far` from the first pass,
    as slips of a rater. Without labels the features count alike.
    """
    given = labels.where(col(labels, level).isNotNull()).groupBy(col(labels, key).alias("__k")).agg(F.avg(col(labels, level)).alias("y"))
    data = cut(scaled.where("lang is not null").join(given, F.col(key) == F.col("__k")).select("y", F.lit(1.0).alias("x0"), *[F.col(f).alias(f"x{i}") for i, f in enumerate(FEATURES, 1)]))
    n = len(FEATURES) + 1
    weights: list[float] | None = None
    for _ in range(2):
        rows = data
        if weights:
            rows = data.where(F.abs(F.col("y") - sum((F.col(f"x{i}") * w for i, w in enumerate(weights)), F.lit(0.0))) <= far)
        sums = rows.agg(F.count("*").alias("n"), *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"a{i}_{j}") for i in range(n) for j in range(i, n)], *[F.sum(F.col(f"x{i}") * F.col("y")).alias(f"b{i}") for i in range(n)]).first()
        if not sums["n"]:
            break
        a = np.array([[sums[f"a{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)], float)
        weights = np.linalg.solve(a + ridge * np.eye(n), np.array([sums[f"b{i}"] for i in range(n)], float)).tolist()
    return weights or [3.0, 0.3, 0.3, 0.3, 0.3]


def reading_levels(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", size: int = 20_000, share: float = 0.8) -> DataFrame:
    """(key, lang, estimate, level) for each text with words; null, empty and blank texts have no row.

    estimate: on the labels' scale of 1 to 5; level: the nearest whole level; both, and lang, null where no language's
    frequent words fit. Repeated rows get equal results; an empty table none. size: how many words of each language
    the tasks hold; the results are the same for any size that holds the languages' frequent words.
    """
    counts = cut(word_counts(df, text, lang))
    found = cut(far_coverage(cut(text_features(df, ranked_vocabulary(counts, size), share, key=key, text=text)), counts))
    # languages differ in their words' lengths and more, so each is measured against its own texts
    own = found.groupBy("lang").agg(*[F.avg(f).alias(f"m_{f}") for f in FEATURES], *[F.stddev_pop(f).alias(f"d_{f}") for f in FEATURES])
    # at most one row for each language
    scaled = found.join(F.broadcast(own), found["lang"].eqNullSafe(own["lang"])).drop(own["lang"]).select(key, "lang", *[F.when(F.col(f"d_{f}") > 1e-9, (F.col(f) - F.col(f"m_{f}")) / F.col(f"d_{f}")).otherwise(0.0).alias(f) for f in FEATURES])
    weights = calibrate(scaled, labels, key)
    estimate = sum((F.col(f) * w for f, w in zip(FEATURES, weights[1:], strict=True)), F.lit(weights[0]))
    leveled = scaled.select(key, "lang", F.when(F.col("lang").isNotNull(), F.least(F.lit(5.0), F.greatest(F.lit(1.0), estimate))).alias("estimate"))
    return leveled.withColumn("level", F.floor(F.col("estimate") + 0.5).cast("int"))
