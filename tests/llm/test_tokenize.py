import random

import pytest

from evidencia.llm import tokenize

P = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def reference():
    t = P.Tokenizer.from_file(f"{tokenize.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda texts: [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


def encoded(texts):
    ends, flat = tokenize.Encoder(keep=50).encode(texts)
    return [flat[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)]


def test_equals_the_library_on_odd_texts(reference):
    rng = random.Random(1)
    signs = " \n\t\r\x1c\x85\xa0abcdeéñ 1²½一٣<|endoftext|>'s'll!?…👩‍🔧ﬁ​\x00Æ"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["<|endoftext|>", "a" * 3000, "ab" * 900, "中文字" * 300, " " * 500, "\n \n" * 90 + "x", "hello" * 700, "word " * 2000]
    assert encoded(texts) == reference(texts)


def test_long_words_take_the_same_merges(reference):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdefgh") for _ in range(n)) for n in (63, 64, 65, 66, 200, 1000)]
    assert encoded(texts) == reference(texts)


def test_rows_nulls_and_other_columns(spark, reference):
    df = spark.createDataFrame([(1, "Hello world", "x"), (2, None, "y"), (3, "", "z"), (4, " ", "w"), (1, "Hello world", "x")], "doc_id long, text string, ids string")
    got = sorted((r[0], r[1]) for r in tokenize.encode(df, piece=5).collect())
    hello, blank = reference(["Hello world", " "])
    assert got == [(1, hello), (1, hello), (2, []), (3, []), (4, blank)]
    counts = tokenize.count_tokens(df, keep=("ids",)).collect()
    assert sorted(map(tuple, counts)) == [(1, "x", 2), (1, "x", 2), (2, "y", 0), (3, "z", 0), (4, "w", 1)]
    assert tokenize.encode(df.limit(0)).count() == 0
