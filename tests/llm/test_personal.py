from threadloom.llm import personal
from threadloom.llm.personal import candidates, estimate, personal_data, redacted, redacted_text, visible

MAIL = """Hallo Frau Kolkmeyr,

Bitte rufen Sie Jana Kolkmeyr unter +49 (0) 30 555 0123 an. Wohnhaft: Gerberstr. 9, 00522 Tarnau. Die Steuer-ID lautet 04 676 588 770.
Die Auftragsnummer 4500519664 passt nicht, die Lizenz endet am 03.09.2022. Berg und Sommer Logistik ist zu.

Von: Kolkmeyr, Jana <jana@veldrin.example>
Von: Ole Kolkmeyr <o@veldrin.example>

Viele Grüße
Ole Kolkmeyr
ole (at) veldrin.example
"""


def test_values_and_lookalikes(spark):
    rows = [(i, MAIL) for i in range(20)] + [(100, None), (101, ""), (102, "Im Sommer ist es warm. Version 10.2.33, Zählerstand 0362 317 555.")]
    got = personal_data(spark.createDataFrame(rows, "id long, body string"), ["id"], "body").where("id in (3, 100, 101, 102)").collect()
    assert {r["id"] for r in got} == {3}
    found = sorted((r["start_pos"], r["pii_type"]) for r in got)
    expected = [("Kolkmeyr,\n", "name"), ("Jana", "name"), ("+49", "phone"), ("Gerberstr", "street_address"), ("04 676", "id_number"), ("Kolkmeyr, Jana", "name"), ("jana@", "email"), ("Ole", "name"), ("o@", "email"), ("Ole Kolkmeyr\n", "name"), ("ole (", "email")]
    assert found == [(MAIL.index(t), k) for t, k in expected]


def test_positions_in_markup():
    text = '<p>K&ouml;nnen Sie <a href="mailto:a.b@x.example">a.b@x.example</a> antworten?</p>'
    assert visible(text)[0].strip() == "Können Sie a.b@x.example antworten?"
    assert sorted(p for k, p, *_ in candidates(text, frozenset(), frozenset()) if k == "email") == [text.index("a.b@"), text.rindex("a.b@")]


def test_votes():
    assert estimate([("phone", "++0", "x", 50), ("phone", "+0-", "x", 50)]) == {("phone", "++0", "x")}


def test_redaction_keeps_all_else(spark):
    rows = [(i, MAIL) for i in range(20)] + [(100, None), (101, ""), (102, "Im Sommer ist es warm.")]
    got = {r["id"]: r["redacted"] for r in redacted(spark.createDataFrame(rows, "id long, body string"), ["id"], "body").collect()}
    assert (got[100], got[101], got[102]) == (None, "", "Im Sommer ist es warm.")
    assert got[0] == """Hallo Frau [NAME],

Bitte rufen Sie [NAME] unter [PHONE] an. Wohnhaft: [STREET_ADDRESS]. Die Steuer-ID lautet [ID_NUMBER].
Die Auftragsnummer 4500519664 passt nicht, die Lizenz endet am 03.09.2022. Berg und Sommer Logistik ist zu.

Von: [NAME] <[EMAIL]>
Von: [NAME] <[EMAIL]>

Viele Grüße
[NAME]
[EMAIL]
"""


def test_redaction_in_markup():
    text = '<p>K&ouml;nnen Sie <a href="mailto:a.b@x.example">a.b&#64;x.example</a>&nbsp;<b>+49 30 555 0123</b> antworten?</p>'
    assert redacted_text(text, candidates(text, frozenset(), frozenset())) == '<p>K&ouml;nnen Sie <a href="mailto:[EMAIL]">[EMAIL]</a>&nbsp;<b>[PHONE]</b> antworten?</p>'


def test_lines_seen_before_give_the_same(monkeypatch):
    given, family = frozenset({"Jana", "Ole"}), frozenset({"Stein", "Brask"})
    lines = ["Jana Stein", "Viele Grüße", "Tel. 030-5551234", "Hallo Jana,", "i.", "V. Stein", "Der Ausweis 123456789", " fehlt", "Nordweg, 7", " und Brandweg 9 stehen", "Herr Brask ruft an: a.b@post.example", "wohnhaft Im Hof 3 b"]
    looked = []
    whole = personal._line_candidates
    monkeypatch.setattr(personal, "_line_candidates", lambda *a: looked.append(a[3]) or whole(*a))
    for text in ["\n".join(lines), "\n".join(reversed(lines)), "\n\n".join(lines[::2] + lines[1::2])]:
        personal._known_lines.cache_clear()
        alone = personal.candidates(text, given, family)
        again = personal.candidates(text + "\n" + text, given, family)
        n = len(text) + 1
        assert alone == again[: len(alone)] and [(k, p + n, v, s, e + n) for k, p, v, s, e in alone][2:] == again[len(alone) :][2:]
    assert looked.count("Tel. 030-5551234") == looked.count("Herr Brask ruft an: a.b@post.example") == 3


def test_tests_before_street_patterns_rule_out_no_street():
    for street in ["Nordweg 7", "Nordweg, 7", "NORDSTR. 7", "Nord Straße 7 a", "Am Alten Tor 3", "Hinterm Berg, 4", "12 bis, rue de la Paix", "7 N. Quarry St.", "C/ Herrería 25", "ul. Nowa 5", "wohnhaft Tief 8"]:
        assert [c[0] for c in personal.candidates(f"Wir, {street}", frozenset(), frozenset())] == ["street_address"], street
