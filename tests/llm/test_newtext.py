from threadloom.llm import newtext
from threadloom.llm.newtext import letters_md5, new_lines, new_lines_of_ticket, newly_written

MAIL = """Hallo Zoë,

die Waage geht wieder.
Reply from 10.1.2.3: bytes=32 time=4ms ttl=64

Viele Grüße
Dr. Ivo Talheimer
--
Versand
Tel. 030-5551234
Von meinem Mobiltelefon gesendet

Vertraulich: Inhalt und Anlagen dürfen ohne unsere Zustimmung nicht weitergegeben werden.

PS: Bitte auch Halle 3 prüfen.

Am 02.02.2022 um 17:05 schrieb Brask, Urs <u.brask@post.example>:
> Guten Tag,
> Wer prüft das?
"""


def words(lines):
    return " ".join(" ".join(lines).split())


def test_top_posted():
    lines, other = new_lines(MAIL, "text/plain")
    assert other
    assert words(lines) == "Hallo Zoë, die Waage geht wieder. Reply from 10.1.2.3: bytes=32 time=4ms ttl=64 PS: Bitte auch Halle 3 prüfen."


def test_bottom_posted_inline_and_forwarded():
    text = "On May 2, 2024, at 10:00, Jana Stein\nwrote:\n> Is it on?\n>\n> Regards\n\nYes, it is.\n> And now?\n\nStill on. LG Jana"
    lines, other = new_lines(text)
    assert other and words(lines) == "Yes, it is. Still on."
    forwarded = "Zur Info.\n\n-----Ursprüngliche Nachricht-----\nVon: Jana Stein\nBetreff: Test\n\nHallo,\nnoch ein Satz."
    assert words(new_lines(forwarded)[0]) == "Zur Info."


def test_markup_gives_roles():
    html = '<html><head><style>p {x:1}</style></head><body><p>K&ouml;nnen Sie helfen?</p><div class="signature"><p>MfG<br>Ole</p></div><blockquote>Von: Ole<br>alt</blockquote>PS. Danke!</body></html>'
    lines, other = new_lines(html, "text/html")
    assert other and words(lines) == "Können Sie helfen? PS. Danke!"


def test_not_history():
    for text in ["> ping 10.1.1.1\n> Zeitüberschreitung bei 3 von 4 Paketen", "Von: Lager 1, nach: Lager 2 - so steht es da.", "Der Text „vertraulich“ wird abgeschnitten.", "Moin,\n\nalles gut."]:
        lines, other = new_lines(text, "text/plain")
        assert not other and words(lines) == " ".join(text.split())


def test_ticket_content():
    lines, other = new_lines_of_ticket("Titel: Test\n\n---\nEins.\n\nGruß\nJana\n---\n<p>Zwei.</p>")
    assert other and words(lines) == "Titel: Test Eins. Zwei."


def test_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "  ", "x"), (3, MAIL, "x"), (3, MAIL, "x"), (4, "Satz. " * 50000, None)], "id long, body string, new string")
    rows = newly_written(df, "body").collect()
    new = {r["id"]: r["new"] for r in rows}
    assert len(rows) == 5 and new[1] is None and new[2]["md5"] == letters_md5([]) == "d41d8cd98f00b204e9800998ecf8427e" and not new[2]["other"]
    assert new[3]["other"] and not new[4]["other"]
    assert newly_written(df.limit(0), "body").count() == 0


def test_introductions_in_more_languages_and_long_tails():
    for intro in ["Dnia 2.05.2024 o 10:00 Jana Stein napisała:", "Dne 2. 5. 2024 v 10:00 Jana Stein napsala:", "Il 2 maggio 2024 alle 10:00 Jana Stein ha scritto:"]:
        lines, other = new_lines(f"OK.\n\n{intro}\nKiedy to będzie?")
        assert other and words(lines) == "OK."
    text = "Hallo,\n\nes geht los.\n\nJana Stein\n" + "Tel. 030-5551234\n" * 8 + "Der Drucker im zweiten Stock druckt seit heute wieder."
    assert "Der Drucker" in words(new_lines(text)[0])


def test_cues_behind_entities_and_in_other_languages():
    assert newtext.new_lines("<p>Die Waage h&auml;ngt.</p><p>Gesch&auml;ftsf&uuml;hrer: Jana Stein, Amtsgericht Tarnau</p>") == (["Die Waage hängt."], True)
    for intro in ("Il giorno 3 mar 2024 alle ore 10:12 Ada Rossi <ada@x.example> ha scritto:", "W dniu 3.03.2024 o 10:12, Jan Nowak pisze:", "Op 3 maart 2024 om 10:12 schreef Jan Smit <j@x.example>:", "Le 3 mars 2024, Ada a &eacute;crit&nbsp;:"):
        lines, other = newtext.new_lines(f"<p>Neu</p><p>{intro}</p><p>alt eins</p><p>alt zwei</p>".replace("<a", "&lt;a").replace("<j", "&lt;j").replace("e>", "e&gt;"))
        assert (lines, other) == (["Neu"], True), intro


def test_unmarked_history_is_told_by_its_ancestor(spark):
    old = ["Der nächtliche Lauf meldet seit Dienstag einen Zeitablauf, sobald das Netz kurz ausfällt, und danach fehlen Daten.", "Die Tabelle mit den Messwerten endet mit Code 581, obwohl seit der Umstellung gar nichts mehr geändert wurde.", "Wir haben das Gerät zweimal neu gestartet."]
    rows = [
        (1, 7, 0, "\n".join(["Guten Tag,", *old])),
        (2, 7, 1, "\n".join(["Bitte einmal abmelden.", *old])),
        (3, 7, 2, "\n".join(["Danke.", old[0]])),  # one sentence alone may come again
        (4, 8, 3, "\n".join(["Anderer Vorgang.", *old])),
        (5, 7, None, "\n".join(["Ohne Platz.", *old])),
        (6, None, 4, "\n".join(["Ohne Vorgang.", *old])),
        (7, 7, 5, "\n".join([old[1], old[0], "Andere Folge."])),
    ]
    df = spark.createDataFrame(rows, "id long, ticket_id long, article_position int, body string")
    found = newtext.newly_written(df.unionByName(df), "body").select("id", "ticket_id", "article_position", "new.*")
    texts = {r["id"]: r["text"] for r in newtext.without_inherited(found, "id", "ticket_id", "article_position").collect()}
    assert texts[2] == "Bitte einmal abmelden."
    assert all(texts[i] == rows[i - 1][3] for i in (1, 3, 4, 5, 6, 7))


def test_copies_of_a_thread_keep_the_first(spark):
    text = "Der Export nach profil.ini dauert über eine Stunde und bricht dann mit einer Meldung ab, die niemand im ganzen Haus kennt oder versteht.\nDas gilt für alle Plätze im Versand und seit gestern auch für die Kasse, jedoch nur am Vormittag und selten danach."
    df = spark.createDataFrame([(i, 1, i, text) for i in range(300)], "id long, ticket_id long, article_position int, body string")
    found = newtext.newly_written(df, "body").select("id", "ticket_id", "article_position", "new.*")
    rows = newtext.without_inherited(found, "id", "ticket_id", "article_position").collect()
    assert sorted((r["id"], r["text"] == text, r["other"]) for r in rows) == [(i, i == 0, i > 0) for i in range(300)]


def test_words_of_law_within_a_report_are_the_senders(spark):
    lines, other = newtext.new_lines("The confidentiality banner is cut off in print. The folder is empty.")
    assert lines == ["The confidentiality banner is cut off in print. The folder is empty."] and not other


def test_signatures_without_closing_words():
    for tail in (["Odile al-Sayedi", "540 Old Foundry Avenue, Havelbrück", "https://ostertor.test"], ["Dr. Ulf Stein", "2nd-Level-Support", "30, avenue du Vieux-Pont, 00522 Oberlohe", "07131/555164"], ["Käthe Stein", "Lumbreda Textil S.L.", "834 W. Quarry St.", "C/ Herrería 25, 3.º izq.", "(555) 010-9506"]):
        assert newtext.new_lines("\n".join(["Die Waage hängt.", "", *tail])) == (["Die Waage hängt."], True)
    assert newtext.new_lines("The scale hangs. BR Łucja") == (["The scale hangs."], True)
    assert newtext.new_lines("Le message indique ERR_46FC.\nTjark") == (["Le message indique ERR_46FC."], True)


def test_articles_of_a_ticket_content_are_compared(spark):
    old = ["Der nächtliche Lauf meldet seit Dienstag einen Zeitablauf, sobald das Netz kurz ausfällt, und danach fehlen Daten.", "Die Tabelle mit den Messwerten endet mit Code 581, obwohl seit der Umstellung gar nichts mehr geändert wurde.", "Wir haben das Gerät zweimal neu gestartet."]
    parts = ["Titel: Lauf", "\n".join(["Guten Tag,", *old]), "\n".join(["Bitte einmal abmelden.", *old]), f"Danke.\n{old[0]}\n{old[2]}"]
    rows = [(1, "\n---\n".join(parts)), (2, "\n---\n".join(parts[:2])), (3, "\n---\n".join([*parts[:2], parts[3]]))]
    df = spark.createDataFrame(rows, "id long, content string")
    new = {r["id"]: r["new"] for r in newtext.newly_written(df, "content", assembled=True).collect()}
    whole = ["Titel: Lauf", "Guten Tag,", *old]
    assert new[1]["text"].split("\n") == [*whole, "Bitte einmal abmelden.", "Danke.", old[0], old[2]] and new[1]["other"]
    assert new[1]["md5"] == letters_md5([*whole, "Bitte einmal abmelden.", "Danke.", old[0], old[2]])
    assert new[2]["text"].split("\n") == whole and not new[2]["other"]
    assert new[3]["text"].split("\n") == [*whole, "Danke.", old[0], old[2]] and not new[3]["other"]  # lines that don't run along
