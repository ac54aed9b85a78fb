from threadloom.llm import residue

PAGES = [
    "502 Bad Gateway\nedge-3/1.2", "JavaScript ist deaktiviert. Die Anwendung kann ohne Skripte nicht angezeigt werden.", "Lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod",
    "Dies ist ein Blindtext. Dies ist ein Blindtext.", "<p>Something went wrong!<br>Bitte laden Sie die Seite neu.</p>", "asdf asdf asdf test", "tuwptj flfq öipuqöirl", "wpsiujwtj qorzwoö tpatlisfo zdqi akz zirwtute afwreökj", "TODO: Text\n\nViele Grüße\nJana Stein",
]
TEMPLATES = ["Hallo {{first_name}},\n\nIhr Vorgang %s wurde an %s übergeben. Der Import läuft wieder." % (a, b) for a, b in [("{{x_id}}", "[LINK]"), ("%due_date%", "<%= a.b %>"), ("«produkt»", "${c}")]]
CLEAN = [
    "Im Browser steht nur:\n502 Bad Gateway\nBitte den Proxy prüfen.", "Muss JavaScript für Inventa aktiviert sein?", "In der Vorlage steht immer noch {{kunde.name}} statt des Namens, bitte korrigieren.",
    "Das Loginskript nutzt %APPDATA%\\Inventa und ${HOME}/bin.", "Die Waage hängt. Bitte melden Sie sich ab und wieder an.", "Im Druckbild sieht man Lorem ipsum, den Blindtext hat die Agentur vergessen.", "Mail an a[at]b[dot]example.", "[2024-01-01] WARN: job 3",
]


def found(spark, texts, title=False):
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    df = residue.with_signals(spark.createDataFrame(rows, "id long, body string, page string"), "body", title=title)
    return {r["id"] for r in residue.residue(df.select("id", "signals"), ["id"]).collect()}


def test_pages_templates_and_reports(spark):
    texts = [*PAGES, *TEMPLATES, *CLEAN, None, "", " \n", "Das ist ein ganz normaler Satz. " * 5000]
    assert found(spark, texts) == set(range(len(PAGES) + len(TEMPLATES)))
    assert found(spark, []) == set()


def test_alignment_tells_slots_from_names(spark):
    named = ["Das Feld enthält $NAME$ im Ausdruck, wieso?"] * 12
    varied = [f"Das Feld enthält {{{{wert_{i}}}}} in Halle 3, danke." for i in range(12)]
    assert found(spark, named + varied) == set(range(12, 24))


def test_titles(spark):
    titles = ["AW: [[Thema]]", "HTTP 500 Internal Server Error", "Neuer Titel (Platzhalter)", "HTTP 503 bei Inventa seit 3:04", "JavaScript im Browser deaktivieren?", "Variable {USER} im Loginskript falsch", "Platzhalter in der Angebotsvorlage", None, ""]
    assert found(spark, titles, title=True) == {0, 1, 2}


def test_copies_of_one_template_count(spark):
    assert found(spark, ["Hallo {{first_name}},\n\nder Termin steht."] * 40 + ["Guten Tag.", "Der Platzhalter {{name}} bleibt leer."]) == set(range(40))


def test_one_report_vetoes_no_other_record(spark):
    texts = ["Ihr Gerät {{device}} wurde ersetzt."] * 3 + ["Im Entwurf steht: Ihr Gerät {{device}} wurde ersetzt, bitte Vorlage prüfen."] + ["Ihr Vorgang {{nr}} ist neu im System."] * 3 + ["Ihr Vorgang {{nr}} ist neu im Template."]
    assert found(spark, texts) == {0, 1, 2, 4, 5, 6}


def test_long_pages_and_signed_filler(spark):
    blind = "Dies ist ein Blindtext. " * 400
    quoted = "502 Bad Gateway\n\nAm 02.02.2022 um 17:05 schrieb Urs Brask <u@post.example>:\n" + "> Die Waage hängt seit dem Umzug.\n" * 300
    mash = "tuwptj flfq öipuqöirl\n\nMit freundlichen Grüßen\nJana Stein"
    assert found(spark, [blind, quoted, mash, "Das ist normal.\n" * 100]) == {0, 1, 2}


def test_gaps_and_bare_names_need_aligned_records(spark):
    filled = [f"Guten Tag Herr {n}, Ihre Bestellung vom {d} wurde versandt." for n, d in [("Stein", "3.4.2022"), ("Koch", "5.6.2023"), ("van der Meer", "7.8.2021")]]
    empty = ["Guten Tag Herr , Ihre Bestellung vom 9.9.2022 wurde versandt.", "Guten Tag Herr LASTNAME, Ihre Bestellung vom 1.2.2022 wurde versandt."]
    alone = ["Im Urlaub vertritt mich Korbinian VORDERBACH.", "Der Drucker , den ich meine, steht im Lager.", "Bitte USERNAME in der Maske prüfen.", "Die Meldung  kommt wieder."]
    assert found(spark, filled + empty + alone) == {3, 4}
    assert found(spark, empty + alone) == set()
    assert found(spark, (filled + empty + alone) * 50) == {i for i in range(450) if i % 9 in (3, 4)}


def test_copies_change_nothing(spark):
    texts = [*PAGES, *TEMPLATES, *CLEAN]
    once = found(spark, texts)
    assert found(spark, texts * 100) == {i + len(texts) * k for k in range(100) for i in once}


def test_sentences_of_other_languages_are_no_filler(spark):
    texts = ["Dziękuję bardzo serdecznie wam wszystkim jutro", "Grazie mille ancora molto davvero sempre", "Yardımınız için teşekkür ederim hepinize iyi çalışmalar", "Спасибо большое вам всем всегда", "Hartelijk bedankt voor jullie snelle hulp gisteren", "Kiitos paljon nopeasta avusta kaikille teille", "proszę sprawdzić skrzynkę pocztową jutro rano"]
    assert found(spark, texts) == set()


def test_repeated_pages_of_other_languages(spark):
    page = "Błąd 404\nStrona nie istnieje\nwróć do strony głównej"
    report = "Im Browser steht nur:\n502 Bad Gateway\nedge-3/1.2\nBitte den Proxy prüfen."
    assert found(spark, [page] * 3 + [report] * 3) == {0, 1, 2}


def test_notice_that_reads_like_a_legal_one(spark):
    assert found(spark, ["Diese Nachricht enthält Inhalte, die nur mit aktivierten Skripten sichtbar sind.", "Die Waage hängt.\n\nDiese Nachricht ist nur für den genannten Empfänger bestimmt."]) == {0}
