import pytest

from evidencia.llm import pii as p2

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def field(spark):
    read = lambda n: spark.read.parquet(f"{DATA}/{n}.parquet")
    return p2.fit_field(read("pdf_pages"), read("crm_contacts"), read("name_forms"))


CASES = {
    "Write to pat.sample+lab@example.test, or ring +1 202 555 0123 ext. 7.": {("email", "pat.sample+lab@example.test"), ("phone", "+1 202 555 0123 ext. 7")},
    "Only in writing: pat (at) example (dot) test.": {("email", "pat (at) example (dot) test")},
    "Order 356-1976-69 covers 43 pcs @ 256 EUR, batch 4923293717, VAT number ZZ 592 720 129, norm EN 413-7, 04.11.2022.": set(),
    "Applicant Robert Sampledorf, passport no. X80342366, may enter.": {("name", "Robert Sampledorf"), ("id_number", "X80342366")},
    "Private address: 103 Sample Road, Sebizon Falls, OH 00856.": {("address", "103 Sample Road, Sebizon Falls, OH 00856")},
    "Muster gehen an Sampleweg 124, 00220 Fizitarburg.": {("address", "Sampleweg 124, 00220 Fizitarburg")},
    "Domicilio privato: Via Sample 9, 00626 Horir (XX); codice personale 971-86-5164.": {("address", "Via Sample 9, 00626 Horir (XX)"), ("id_number", "971-86-5164")},
    "Образцы шлите по адресу ул. Шамотская, д. 83, 000196 г. Печорск.": {("address", "ул. Шамотская, д. 83, 000196 г. Печорск")},
    "Solo por escrito o por fax +39 06 0000\n2450.": {("phone", "+39 06 0000\n2450")},
    "Acceso permitido a Evgenia Sampletini, con DNI 00 07   359678.\n\n12 piezas": {("name", "Evgenia Sampletini"), ("id_number", "00 07   359678")},
    "The Sample process is a trade name of Example Steel Trading GmbH.": set(),
    "": set(),
}


@pytest.mark.parametrize("text", CASES)
def test_cases(field, text):
    assert {(k, text[a:b]) for a, b, k in field.spans(text)} == CASES[text]


def node(i, z, key, kind="name"):
    return p2.Node(i, i + 1, key, kind, z=z, token=10 * i if kind == "name" else -1)


def test_skip_edges_carry_a_label_to_a_bare_place():
    f = p2.Field(p2.Settings())
    nodes = [node(0, 4.0, "sampledorf"), node(1, -0.5, "sampledorf"), node(2, -0.5, "other"), node(3, -0.3, "vikorski"), node(4, 5.0, "pat.vikorski@a.test", "email")]
    edges = f._edges(nodes, p2.Words("x", [], frozenset()))
    assert sorted(edges) == [(0, 1, "skip"), (3, 4, "mail")]
    assert f.decide(nodes, edges) == [True, True, False, True, True]
    assert f.decide(nodes, []) == [True, False, False, False, True]


def test_messages_equal_exact_marginals():
    f = p2.Field(p2.Settings(rounds=60))
    own, links = [1.5, -0.7, -0.4, 0.2], [(0, 1, 0.8), (1, 2, 0.5), (1, 3, 0.3)]
    at = {}
    for a, b, j in links:
        at.setdefault(a, []).append((b, j))
        at.setdefault(b, []).append((a, j))
    import itertools
    import math

    weight = {x: math.exp(sum(o * v for o, v in zip(own, x, strict=True)) + sum(j * (x[a] == x[b]) for a, b, j in links)) for x in itertools.product((0, 1), repeat=4)}
    exact = [math.log(sum(w for x, w in weight.items() if x[i]) / sum(w for x, w in weight.items() if not x[i])) for i in range(4)]
    assert f._odds([0, 1, 2, 3], own, at) == pytest.approx(exact, abs=5e-3)


SURNAMES = "Sampledorf Samplemayr Vikorski Norvakel Sebizoni Tuvikall Horirmann Fizitar Gorvakel Zulimann".split()
#: Sentences in which a surname stands bare; only another place of the page tells that it is one.
BARE = ["The plan was agreed with {} in March.", "According to {} the kiln runs well.", "Then {} left the works.", "Der Plan wurde mit {} besprochen.", "Laut {} läuft der Ofen gut."]
TRAPS = ["The {} process is in use since 1990.", "{} Minerals GmbH delivers the sand."]


def test_edges_decide_on_bare_surnames(field):
    """Without the edges recall falls on surnames that only a distant place tells; firms of such names stay no names."""
    found = {True: 0, False: 0}
    wrong = alone = total = 0
    filler = "The laboratory tests quartz sand every month. " * 4
    for i, n in enumerate(SURNAMES):
        for bare in BARE:
            text = f"Contact: Robert {n}, purchasing.\n\n{filler}\n\n{bare.format(n)}"
            total += 1
            for linked in found:
                found[linked] += ("name", n) in {(k, text[a:b]) for a, b, k in field.spans(text, linked)}
            lone = f"{filler}\n\n{bare.format(n)}"
            alone += ("name", n) in {(k, lone[a:b]) for a, b, k in field.spans(lone)}
        text = f"Contact: Robert {n}, purchasing.\n\n{filler}\n\n{TRAPS[i % 2].format(n)}"
        wrong += any(text[a:b].startswith(n) for a, b, _ in field.spans(text))
    assert found[True] >= 0.75 * total and max(found[False], alone) <= 0.6 * found[True] and wrong <= 2, (found, alone, wrong)


def test_matches_at_the_edge_of_a_window_are_whole():
    long = "a" * 300 + "@" + ".".join(["sub" * 10] * 9) + ".test"
    assert [(n.kind, long == n.key) for n in p2.fixed_nodes("write to " + long + " today")] == [("email", True)]


def test_find_and_redact(spark, field):
    text = "Contact: Robert Sampledorf\nTel. +1 202 555 0123\nE-Mail: info@example.test"
    df = spark.createDataFrame([(1, text, "x"), (2, None, "y"), (3, "", "z"), (1, text, "x"), (4, "word " * 20000 + "info@example.test", "w")], "page_id long, markdown string, pii_type string")
    clean = {(r["page_id"], r["markdown"], r["pii_type"]) for r in p2.redact(df, field).collect()}
    assert (1, "Contact: [NAME]\nTel. [PHONE]\nE-Mail: [EMAIL]", "x") in clean and (2, None, "y") in clean and (3, "", "z") in clean
    found = p2.find_pii(df, field).collect()
    assert all(r["pii_value"] == (text if r["page_id"] == 1 else "word " * 20000 + "info@example.test")[r["start"] : r["stop"]] for r in found)
    assert len(found) == 7 and p2.find_pii(df.limit(0), field).count() == 0


def test_a_word_that_is_often_no_name_is_still_decided_on():
    names = "Sampledorf Samplemayr Vikorski Norvakel Sebizoni Tuvikall Horirmann Fizitar".split()
    texts = [f"Ansprechpartner: Robert {n}, Einkauf. Fragen an Ingrid {n}, Versand." for n in names] + ["Der Koch prüft den Ofen. Ein Koch heizt ihn an."] * 4
    f = p2.Field(p2.Settings(givens=frozenset({"robert", "ingrid"}))).fit(texts)
    text = "Ansprechpartner: Robert Koch, Einkauf. Der Koch prüft den Ofen."
    words = p2.Words(text, [], f.s.givens)
    assert [words.word[i] for i in sorted(words.named)].count("Koch") == 2
    assert ("name", "Robert Koch") in {(k, text[a:b]) for a, b, k in f.spans(text)}


NAMES = {
    "call Juan García López today": ["Juan García López"],
    "call Juan Carlos García López today": ["Juan Carlos García López"],
    "call Anna van der Berg today": ["Anna van der Berg"],
    "call Anna B. de la Vega Ruiz today": ["Anna B. de la Vega Ruiz"],
    "Juan García López\nAnna Berg\nJuan Ruiz": ["Juan García López", "Anna Berg", "Juan Ruiz"],
    "García Juan\nBerg Anna\nRuiz Carlos": ["García Juan", "Berg Anna", "Ruiz Carlos"],
    "Juan Ruiz Anna Berg": ["Juan Ruiz", "Anna Berg"],
    "J. García\nA. Berg": ["J. García", "A. Berg"],
    "Juan den Berg": ["Berg"],
    "Juan García and Berg": ["Juan García", "Berg"],
}


@pytest.mark.parametrize("text", NAMES)
def test_names_of_any_number_of_words(text):
    words = p2.Words(text, [], frozenset({"juan", "anna", "carlos"}))
    assert [text[a:b] for a, b in p2.assemble(words, words.named)] == NAMES[text]


def test_the_fit_sees_all_pages_and_whole_texts(spark):
    """Plain names far down in long texts, one shape of them on the last of 1,200 pages only."""
    filler = "The laboratory tests quartz sand every month. " * 150
    rows = [(i, f"{filler}Ansprechpartner: Robert {n}, Einkauf.") for i, n in enumerate(SURNAMES)]
    rows += [(i, "Der Ofen ist warm.") for i in range(len(rows), 1200)] + [(1200, "Ofen 12 wartet Herr Sampledorf.")]
    field, proposed = p2.fitted(spark.createDataFrame(rows, "page_id long, markdown string"))
    labels = sum(int(p2.unpacked(r["silver"])["times"][p2.unpacked(r["silver"])["label"]].sum()) for r in proposed.collect())
    assert labels > 2 * len(SURNAMES)
    text = "Ansprechpartner: Robert Norvikadorf, Einkauf."
    assert {(k, text[a:b]) for a, b, k in field.spans(text)} == {("name", "Robert Norvikadorf")}


def test_given_names_are_counted_over_all_names(spark):
    words = lambda n: "".join(chr(97 + int(c)) for c in str(n))
    rows = [(f"X{words(i)}q Y{words(i)}q",) for i in range(25_000)] + [(f"Zelmar Q{words(i)}z",) for i in range(50)] + [(f"Tomvik R{words(i)}z",) for i in range(49)]
    given = p2.given_names(spark.createDataFrame(rows, "name string"))
    assert len(rows) // 500 == 50 and "zelmar" in given and "tomvik" not in given


def test_proposals_give_what_the_texts_give(spark, field):
    texts = ["Contact: Robert Sampledorf\nTel. +1 202 555 0123", None, "", "Then Sampledorf left. Write to r.sampledorf@example.test, Robert Sampledorf.", "no one here"] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "page_id long, markdown string")
    field.s.chunk = 60  # many rows of proposals
    proposed = p2.proposals(df, field)
    assert proposed.count() > 3
    assert sorted(p2.find_proposed(proposed, field, "bigint").collect()) == sorted(p2.find_pii(df, field).collect())
    assert sorted(map(str, p2.redact_proposed(proposed, field, "bigint").collect())) == sorted(map(str, p2.redact(df, field).collect()))
    assert p2.find_proposed(p2.proposals(df.limit(0), field), field, "bigint").count() == 0
    assert not p2.Field(p2.Settings()).fit_proposed(p2.proposals(df.limit(0), field)).w.any()
