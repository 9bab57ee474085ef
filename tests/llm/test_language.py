import numpy as np
import pytest

from evidencia.llm import language as p3

DATA = "/root/testdata/sf0.01"
EN = "The plant makes crucibles and filter discs for foundries in many countries. Every buyer may ask for a certificate that states their density."
FR = "Les commandes sont expédiées sur palettes en neuf semaines. Chaque client reçoit sur demande un certificat de densité pour ses creusets."


@pytest.fixture(scope="module")
def model(spark):
    return p3.fit_model(spark.read.parquet(f"{DATA}/lang_samples.parquet"), (spark.read.parquet(f"{DATA}/documents.parquet"), "doc_id", "text", "lang"))


def test_codewords_are_far_apart():
    code = p3.codewords(9)
    apart = [(code[i] != code[j]).sum() for i in range(9) for j in range(i)]
    assert code.shape == (9, 15) and min(apart) >= 7
    assert all(abs(c.sum()) < 9 for c in code.T)


def test_labels():
    assert [p3.canonical(x) for x in ("pt-BR", "ger", "Deutsch", "EN", "en_US", "und", "", None, "unknown", "русский")] == ["pt", "de", "de", "en", "en", None, None, None, None, "ru"]


def test_held_out_sentences(model):
    held = {
        "en": "We would like to know when the next delivery of the ordered parts will arrive.",
        "de": "Wir möchten gerne wissen, wann die nächste Lieferung der bestellten Teile eintrifft.",
        "fr": "Nous voudrions savoir quand arrivera la prochaine livraison des pièces commandées.",
        "es": "Nos gustaría saber cuándo llegará la próxima entrega de las piezas pedidas.",
        "it": "Vorremmo sapere quando arriverà la prossima consegna dei pezzi ordinati.",
        "pt": "Gostaríamos de saber quando chegará a próxima entrega das peças encomendadas.",
        "nl": "Wij zouden graag weten wanneer de volgende levering van de bestelde onderdelen aankomt.",
        "pl": "Chcielibyśmy wiedzieć, kiedy przyjdzie następna dostawa zamówionych części.",
        "ru": "Мы хотели бы знать, когда придёт следующая поставка заказанных деталей.",
    }
    best, share = model.score([p3.content(p3.WORD.findall(t)) for t in held.values()])
    assert [model.s.languages[i] for i in best] == list(held)
    assert np.allclose(share.sum(1), 1)


def test_names_and_addresses_say_nothing_of_the_language():
    words = p3.WORD.findall("Concepción Ardemayr notou a trinca e ligou para o turno")
    assert p3.content(words)[0] == "notou"
    assert p3.content("Der Ofen ist neu".split()) == ["der", "ist", "neu"]
    assert p3.tidy("Somente por escrito:  info at      fabrika dot invalid.").strip() == "Somente por escrito:"


def test_segments(spark, model):
    rows = [(1, EN, "de"), (2, f"{EN}\n\n{FR}\n\n{EN}", "en"), (3, None, "en"), (4, " \n", "en"), (5, "12 34", "en"), (6, EN, "en-GB"), (7, "", None), (8, f"{EN}\n\n{EN} {FR}", None)]
    df = spark.createDataFrame(rows, "page_id long, markdown string, declared_lang string")
    got = sorted((r["page_id"], r["para_no"], r["lang"]) for r in p3.wrong_labels(df, model).collect())
    assert got == [(1, 0, "en"), (2, 1, "en"), (2, 2, "fr"), (2, 3, "en"), (8, 1, "en"), (8, 2, "en"), (8, 2, "fr")]
    assert p3.wrong_labels(df.limit(0), model).count() == 0
    assert all(0 < r["confidence"] <= 1 for r in p3.segment(df, model).collect())


def test_unfitted_model_still_answers(spark):
    empty = spark.createDataFrame([], "sample_id long, lang string, text string")
    m = p3.fit_model(empty)
    assert p3.segment(spark.createDataFrame([(1, EN)], "page_id long, markdown string"), m).count() >= 1


def test_short_sentences_prove_a_second_language_by_script_or_together(spark, model):
    short = "Wir sind seit vielen Jahren da. Das ist ein guter Ofen. Der Ofen ist noch neu."
    rows = [(1, f"{EN}\n\nМы работаем давно для всех вас.\n\n{EN}\n\nПечи новые и очень хорошие у нас.", None), (2, f"{EN}\n\n{short}", None), (3, EN, None)]
    df = spark.createDataFrame(rows, "page_id long, markdown string, declared_lang string")
    got = {(r["page_id"], r["para_no"], r["lang"]) for r in p3.wrong_labels(df, model).collect()}
    assert {(2, 1, "en"), (2, 2, "de"), (3, 0, "en")} <= got and (1, 0, "en") not in got


def test_one_short_sentence_in_another_script(spark, model):
    df = spark.createDataFrame([(1, f"{EN}\n\nВсе наши печи новые.")], "page_id long, markdown string")
    assert any(r["mixed"] for r in p3.segment(df, model).collect())
