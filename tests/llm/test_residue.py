from evidencia.llm import residue as p5

REAL = "The plant makes crucibles and filter discs for foundries in many countries. Our engineers check every mixer before the crucibles leave the yard. Orders above ten tonnes are packed on pallets and shipped within two weeks of the order. Every buyer may ask for a certificate that states the density of the crucibles."
CASES = {
    "Error 404 - the file you want is gone\n\nTry the search box or check the address.": True,
    "Bitte aktivieren Sie JavaScript, um das Dokument zu sehen.": True,
    "Dear {{name}},\n\nthank you for asking {{company_name}} about {{product title}}.\n\nKind regards\n{{contact}}": True,
    "[PDF page 1]\n# <<intro text>>\n\n- %%price%%\n- _logo_TBD_": True,
    "Lorem ipsum dolor sit amet donec mauris. Tellus massa vitae lorem ipsum orci porta nulla velit lectus varius augue. Donec amet porta lorem ipsum.": True,
    "Click to add text\n\nplaceholder copy": True,
    "Login needed. Only registered partners can open this document.\n\nAccount: ____": True,
    REAL: False,
    REAL + " <intro text>": False,
    "When the kiln shows error 404 on its panel, the crucibles must be taken out and the fault logged by the team.": False,
    "Our trainee filled the first draft with lorem ipsum, but the text about fire bricks was written later by hand.": False,
    "Heading alone": False,
}


#: Nine or more units of middle length, or three long ones, that are all residue.
MANY = [
    "Beispieltext für den Absatz auf der linken Seite des Blattes.\n\n" * 10,
    "Aquí va su texto de relleno para la columna de la derecha.\n\n" * 9,
    "".join(f"The server reports error 50{i} and asks you to try again after some time.\n\n" for i in range(10)),
    "".join(f"Please log in with the account of section {i} to read this document here.\n\n" for i in range(10)),
    "Beispieltext Aufbereitungsanlagenbeschreibung Feuerfesterzeugnisherstellung Qualitätssicherungsvereinbarung Wareneingangsprüfung.\n\n" * 3,
]


def found(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, title string, error string, markdown string, units string")
    return {r[0] for r in p5.find_residue(df).collect()}


def test_cases(spark):
    rows = [(i, f"https://s{i}.test/files/a{i}.pdf", None, "sheet 1: unknown filter" if i % 2 else "", t, "u") for i, t in enumerate(CASES)]
    assert found(spark, rows) == {i for i, want in enumerate(CASES.values()) if want}


def test_long_pages_of_residue(spark):
    rows = [(i, f"https://s{i}.test/files/a{i}.pdf", None, None, t, "u") for i, t in enumerate(MANY)]
    rows += [(10 + i, f"https://t{i}.test/files/b{i}.pdf", None, None, t + REAL, "u") for i, t in enumerate(MANY)]
    assert found(spark, rows) == set(range(len(MANY)))


def test_a_long_unit_that_stands_beside_content_elsewhere_is_no_residue(spark):
    legal = "the crucibles of this sheet are made of clay and graphite and fired twice in the old kiln before they leave the yard"
    rows = [(i, f"https://s{i}.test/files/a{i}.pdf", None, None, f"Page introuvable\n\n{legal}", "u") for i in range(3)]
    assert found(spark, rows) == {0, 1, 2}
    assert found(spark, rows + [(7, "https://t.test/files/b.pdf", None, None, f"{REAL} {REAL} {REAL}\n\n{legal}", "u")]) == set()


def test_the_hosts_show_messages_that_no_list_holds(spark):
    message = "Zorbu nixt hier fanden kun, mog elder soeken.\n\nVelko prag oben drukt."
    shop = "Klinker und Platten holt man vor Ort im Hof ab."  # as short and as frequent, but it stands beside content too
    rows = [(i, f"https://h{i % 40}.test/files/{'abcdefghij'[i % 10] * 3}{i}.pdf", None, None, message, "") for i in range(60)]
    rows += [(100 + i, f"https://h{i}.test/files/k{i}.pdf", None, None, f"[PDF page 1]\n{shop}", "") for i in range(9)]
    rows += [(200 + i, f"https://g{i}.test/files/r{i}.pdf", None, None, f"{REAL}\n\n{shop}", "") for i in range(2)]
    # real short pages of one wording whose slug and title speak of the same
    rows += [(300 + i, f"https://f{i}.test/files/preisliste-{i}.pdf", f"Preisliste {i}", None, f"Die preisliste senden wir gern zu, bitte anrufen {i}.", "") for i in range(9)]
    assert found(spark, rows) == set(range(60))


def test_without_any_list_of_messages_most_residue_is_found(spark, monkeypatch):
    pages = spark.read.parquet("/root/testdata/sf0.1/pdf_pages.parquet")
    whole = {r[0] for r in p5.find_residue(pages).collect()}
    monkeypatch.setattr(p5, "MESSAGE", p5._any(p5.FILLER))
    bare = {r[0] for r in p5.find_residue(pages).collect()}
    assert bare <= whole and len(bare) >= 0.9 * len(whole)


def test_blank_pages_count_with_an_error_only(spark):
    rows = [(1, "u", None, "HTTP 404", None, ""), (2, "u", None, "HTTP 404", " \n\xa0", ""), (3, "u", None, "", "", ""), (4, "u", None, None, None, ""), (5, None, None, " ", None, "")]
    assert found(spark, rows) == {1, 2}
    assert found(spark, rows[:0] or [(9, None, None, None, None, None)]) == set()


def test_lines_of_the_site_do_not_hide_residue(spark):
    legal = "All rights reserved: no part of this leaflet may be copied without approval"
    rows = [(i, f"https://a.test/{i}.pdf", None, None, f"{legal}\n\n{REAL}", "") for i in range(4)]
    rows += [(7, "https://a.test/7.pdf", None, None, f"{legal}\n\nPage introuvable\n\nCe lien ne mène nulle part.", "")]
    assert found(spark, rows) == {7}


def test_exclude_keeps_the_rest(spark):
    df = spark.createDataFrame([(1, "u", None, "x", None), (2, "u", None, None, REAL), (2, "u", None, None, REAL), (None, None, None, None, None)], "page_id long, url string, title string, error string, markdown string")
    assert sorted((r[0] or 0) for r in p5.exclude_residue(df).collect()) == [0, 2, 2]
