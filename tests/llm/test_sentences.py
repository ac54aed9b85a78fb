from threadloom.llm.sentences import unit_starts, with_units


def units(text, chat=None):
    starts = unit_starts(text, chat)
    return [text[a:b].strip() for a, b in zip(starts, [*starts[1:], None])]


def test_abbreviations_quotations_and_ordinals():
    for text in ["Das gilt z. B. für Raum B3.07.", "Der Schirm zeigt „Bitte warten. Es lädt.“ und steht.", "Am 3. Mai um 9.15 Uhr im 3. Stock.", "Sie (vgl. Anl. 3 u. 4) fehlt.", "Es springt ... und steht.", "他问：“可以吗？”我们说可以。"]:
        assert units(text) == [text]


def test_sentences_of_several_scripts():
    assert units("Erst kam nichts... Warum ist das so?! 🙂 Mit Rev. B nicht, s. o. Der Rest.Dann geht es.") == ["Erst kam nichts...", "Warum ist das so?! 🙂", "Mit Rev. B nicht, s. o.", "Der Rest.", "Dann geht es."]
    assert units("谢谢！昨天还是好的；今天不行了。") == ["谢谢！", "昨天还是好的；今天不行了。"]
    assert units("¿Va? ¡Sí! No.") == ["¿Va?", "¡Sí!", "No."]
    assert units("Πότε θα διορθωθεί; Ευχαριστώ!") == ["Πότε θα διορθωθεί;", "Ευχαριστώ!"]
    assert units("ขอบคุณค่ะ ไฟล์ a.txt หายไป") == ["ขอบคุณค่ะ", "ไฟล์ a.txt หายไป"]
    assert units("रुकें। ठीक है।") == ["रुकें।", "ठीक है।"]


def test_lines():
    text = "Guten Tag,\r\n\r\nDer Abgleich der Adressbücher verlangt eine Bestätigung, obwohl\r\nnichts geändert wurde. Das ist\r\nneu.\r\n \r\n- Eins. Zwei\r\n- Drei\r\n\r\nViele Grüße\r\nTeam Lager"
    assert [u.replace("\r\n", " ") for u in units(text)] == ["Guten Tag,", "Der Abgleich der Adressbücher verlangt eine Bestätigung, obwohl nichts geändert wurde.", "Das ist neu.", "- Eins. Zwei", "- Drei", "Viele Grüße", "Team Lager"]
    assert units("die waage hängt. Sie piept\nund nun", chat=True) == ["die waage hängt. Sie piept", "und nun"]


def test_rows(spark):
    rows = [(1, None, None), (2, " \n", "x"), (3, "Ja. Nein.", None), (4, "Das geht. " * 20000, "mail")]
    got = {r["id"]: r["starts"] for r in with_units(spark.createDataFrame(rows, "id long, text string, source string"), "text", "source").collect()}
    assert got[1] == got[2] == [] and got[3] == [0, 4] and len(got[4]) == 20000
