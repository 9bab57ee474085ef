"""Many texts read as columns give what each text gives word by word."""

import random
import sys
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from evidencia.llm import pii as p2

GIVENS = frozenset("robert anna juan carlos zoltán".split())
PIECES = (
    "Robert Anna Juan Sampledorf Samplemayr Berg van der de la den von Zoltán Z. J. É. A.B. Dr. Dr Herr Mr . , ; ! ? : ( ) [ ] - – -\n \n \n\n \t \r\n * # | > _ ' ’ ’s d’Or O'Neil Mc-Kay "
    "deter-\nminano Samp-\nledorf é ́ ́́ ' '' ²x 5G. 3D x5 12 345678 +49 30 0000 1234 passport no. X80342366 tel. 0 GmbH Ltd Steel process robert@example.test sampledorf.anna@example.test "
    "(at) example (dot) test Иван Петров Горький ул. Шамотская, д. 83, 000196 г. Печорск ß İstanbul ǅ 𝐀bc \x1c   １２ Koch Köch Kochs Samplemayer Sampledorfs AB ABC. I. II. ^ $"
).split(" ")


def texts(n: int = 400) -> list:
    draw = random.Random(5)
    odd = ["".join(draw.choice(PIECES) + draw.choice(["", " ", " ", " ", " ", "\n", "  ", "\n\n"]) for _ in range(draw.randrange(60))) for _ in range(n)]
    return [None, "", "\n", *odd, "'a", "Robert", "Sampledorf-", "\nletter", *pq.read_table("/root/testdata/sf0.01/pdf_pages.parquet").column("markdown").to_pylist()[:150]]


def silver(words: p2.Words, i: int) -> bool:
    """The label of word i, from the places beside it."""
    n = len(words.word)
    other = lambda j: 0 <= j < n and words.candidate(j) and j not in words.given
    after = lambda j: j + 1 < n and words.near(j, j + 1) and (other(words.behind(j)) or words.initial(j + 1) and j + 2 < n and words.near(j + 1, j + 2) and other(j + 2))
    if i in words.given:
        before = i > 0 and words.near(i - 1, i) and other(i - 1)
        return bool(after(i) or before or (i > 1 and words.word[i - 1] == "," and other(i - 2)))
    if i + 1 < n and words.bare(i + 1) in p2.TRADE:
        return False
    if words.before(i) in words.given:
        return True
    if i > 0 and words.near(i - 1, i) and words.initial(i - 1) and words.word[i - 1].endswith("."):
        return True
    if i > 1 and words.initial(i - 1) and (i - 2 in words.given) and words.near(i - 2, i - 1) and words.near(i - 1, i):
        return True
    if i + 1 < n and (i + 1 in words.given) and words.near(i, i + 1):
        return not after(i + 1)
    comma = i + 2 < n and words.word[i + 1] == "," and (i + 2 in words.given) and not after(i + 2)
    return words.title(i) or comma and not (i > 0 and (i - 1 in words.given))


def label(nodes: list[p2.Node], words: p2.Words) -> None:
    for n in nodes:
        if n.token >= 0:
            n.silver = any(n.parts[-1][2:8]) and bool(silver(words, n.token))
    plain = {n.key for n in nodes if n.token >= 0 and n.silver}
    for n in nodes:
        if n.token >= 0 and not n.silver and n.key in plain and not (n.token + 1 < len(words.word) and words.bare(n.token + 1) in p2.TRADE):
            n.silver = None


def test_columns_give_what_each_text_gives():
    field = p2.Field(p2.Settings(givens=GIVENS))
    many = texts()
    found, parts, learn = field.propose(many)
    ends = np.cumsum(parts["sizes"]).tolist()
    spelt = [frozenset(parts["features"][b - n : b].tolist()) for b, n in zip(ends, parts["sizes"].tolist(), strict=True)]
    features = lambda node: tuple(frozenset(p2._hash(f, field.s.dims) for f in p2.spelt(x)) for x in node) + (frozenset(),) * (p2.WIDTH - len(node))
    forms = [tuple(spelt[i] for i in form) for form in parts["forms"].tolist()]
    rows: Counter = Counter()
    at = edge = 0
    for text, per, linked in zip(many, found["per"], found["linked"], strict=True):
        nodes, words = field._nodes(text) if text else ([], None)
        edges = field._edges(nodes, words, all_=True) if nodes else []
        got = [(a, b, p2.KINDS[kind], token, forms[form]) for a, b, kind, token, form in found["at"][at : at + per].tolist()]
        assert got == [(n.start, n.end, n.kind, n.token, features(n.parts)) for n in nodes], text
        links = Counter((min(a, b), max(a, b), p2.EDGES[kind]) for a, b, kind in found["links"][edge : edge + linked].tolist())
        assert links == Counter((min(a, b), max(a, b), kind) for a, b, kind in edges), text
        at, edge = at + per, edge + linked
        label(nodes, words)
        around = [[0] * len(p2.EDGES) for _ in nodes]
        for a, b, kind in edges:
            for i, j in ((a, b), (b, a)):
                if nodes[j].silver is not None:
                    around[i][p2.EDGE[kind]] += 1 if nodes[j].silver else -1
        for n, beside in zip(nodes, around, strict=True):
            if n.silver is not None:
                rows[features(n.parts), n.silver, tuple(beside)] += 1
                if any(beside):
                    rows[features(tuple(map(p2.hidden, n.parts))), n.silver, tuple(beside)] += 1
    learnt: Counter = Counter()
    for form, yes, beside, times in zip(learn["form"].tolist(), learn["label"].tolist(), learn["around"].tolist(), learn["times"].tolist(), strict=True):
        learnt[forms[form], yes, tuple(beside)] += times
    assert learnt == rows and len(rows) > 1000


def test_words_of_a_text_among_others():
    many = [text or "" for text in texts()]
    pages = p2.Pages(many).take([(t, 3, 9) for t, text in enumerate(many) if t % 2 and len(text) > 9])
    for t, text in enumerate(many):
        one, among = p2.Words(text, [p2.Node(3, 9, "", "phone")] if t % 2 and len(text) > 9 else [], GIVENS), pages.words(t, GIVENS)
        assert (one.word, one.start, one.stop, one.inside, one.named, one.given) == (among.word, among.start, among.stop, among.inside, among.named, among.given), text
        assert one.word == p2.WORD.split(text)[1::2]


def test_alike_is_one_edit_or_a_swap():
    from evidencia.llm.names import distance

    draw = random.Random(3)
    words = ["".join(draw.choice("ab") for _ in range(draw.randrange(7))) for _ in range(150)]
    assert all(p2.alike(x, y) == (distance(x, y, 1) <= 1) for x in words for y in words)


def test_hints_leave_out_no_address():
    """In every stretch the patterns that are tried find what all patterns find."""
    import regex

    every = regex.compile("|".join(p2.ADDRESS))
    for text in pq.read_table("/root/testdata/sf0.1/pdf_pages.parquet").column("markdown").to_pylist():
        for lo, hi in p2.windows([m.start() for m in p2.POSTCODE.finditer(text or "")], 140, 80, text or ""):
            assert [m.span() for m in p2.Addresses.finditer(text, lo, hi)] == [m.span() for m in every.finditer(text, lo, hi)]


@pytest.mark.parametrize("most", [30])
def test_the_cost_of_a_node(most):
    """Reading and fitting call few functions for a node; the check tool's budget leaves no room for a loop over words."""
    field = p2.Field(p2.Settings(givens=GIVENS))
    many = pq.read_table("/root/testdata/sf0.1/pdf_pages.parquet").column("markdown").to_pylist()[:1500]
    calls = 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        found, parts, learn = field.propose(many)
        p2.learnt(parts, learn, field.s.dims, field.s.epochs)
    finally:
        sys.setprofile(None)
    assert calls <= most * len(found["at"]), calls / len(found["at"])
