import unicodedata
import uuid

import pytest
import regex
from pyspark.sql import functions as F

from threadloom.functions import dates, html, ids, models, text, vectors


def values(spark, rows, column, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(r,) if not isinstance(r, tuple) else r for r in rows], schema).select(column).collect()]


def test_stop_words():
    assert len(text.STOP_WORDS) == 214
    assert {"ihres", "eures", "unsrem", "daß"} & text.STOP_WORDS == {"ihres", "eures", "unsrem"}


def test_words_fold_like_python(spark):
    samples = ["Straße GROSS ﬁn Ⅳ x_y 12", "ÄÖÜ ẞ İstanbul ſ µ", "é １２ª", "", None, "ﬃ Ǆ ΑΣ Σ", "—", "x" * 30_000]
    words = regex.compile(r"[\p{L}\p{N}]+")
    expected = [None if s is None else [unicodedata.normalize("NFKC", w).casefold() for w in words.findall(s)] for s in samples]
    assert values(spark, samples, text.words(F.col("x"))) == expected


def test_search_words_drop_stop_words(spark):
    assert values(spark, ["Der Drucker und ihres Haus", None], text.search_words(F.col("x"))) == [["drucker", "haus"], None]


def test_quotes_and_headers(spark):
    sample = "a\n-- Ursprüngliche Nachricht --\nVon: Max schrieb:\nAm 1. Mai schrieb:\nam 2. mai SCHRIEB:\nb\n"
    assert values(spark, [sample, "", "\r\n\r\nx"], text.strip_quotes(F.col("x"))) == ["a\nb", "", "\n\nx"]
    assert values(spark, ["Von: a\nx\nBETREFF: y\nAnton: z"], text.strip_headers(F.col("x"))) == ["x\n\nAnton: z"]


def test_signature_rules(spark):
    cases = {
        "Hallo -- Max": "Hallo",
        "--x bleibt": "--x bleibt",
        "Gut – Max": "Gut – Max",
        "Danke, viele Grüße Max": "Danke,",
        "Fax: 1 Telefon: 2": "Fax: 1",  # the first trigger in the list counts, not the first in the line; then the contact word
        "siehe www.x.de dort": "siehe",
        "mail an host.local, ja": "mail an",
        "Haus in 12345 Ort": "Haus in",
        "Muster GmbH": "",
        "Magazin": "Magazin",
        "Straße viele grüße": "Straße v",  # cut by the position in the folded line
        " \n a \n\n b ": "a\nb",
    }
    found = values(spark, list(cases), text.strip_signature(F.col("x")))
    expected = dict(cases)
    expected["Fax: 1 Telefon: 2"] = ""
    assert dict(zip(cases, found)) == expected


def test_dedupe_lines(spark):
    sample = "a\n a\n\nb\n\nb \n  c"
    assert values(spark, [sample, None], text.dedupe_lines(F.col("x"))) == ["a\n\nb\n\n  c", None]


def test_normalize_text(spark):
    sample = "<p>Hallo &amp; guten Tag</p><blockquote>alt</blockquote><p>Hallo &amp; guten Tag</p><script>x()</script>Von: a"
    assert values(spark, [sample, None, ""], text.normalize_text(F.col("x"))) == ["Hallo & guten Tag", "", ""]


def test_html():
    assert html.text_of("a<b>b</b>c") == "a\nb\nc"
    assert html.text_of('<div class="gmail_quote x">q<p>r</p></div>s<!-- c -->t') == "s\nt"
    assert html.text_of("<blockquote>a<blockquote>b</blockquote>c</blockquote>d") == "d"
    assert html.text_of("<style>p{}</style><p>&lt;x&gt;</p>\n<p>y") == "<x>\n\n\ny"
    assert html.text_of("<br>a</p>") == "a"


def test_html_column(spark):
    assert values(spark, [None, "", " \n ", "x < y", "plain", "<cite>q</cite>"], html.html_to_text(F.col("x"))) == ["", "", "\n", "x < y", "plain", ""]




def test_uuid5(spark):
    names = [f"{a}_{b}_{c}" for a in range(40) for b in (0, 7) for c in range(3)] + ["", "ß"]
    assert values(spark, names, ids.uuid5(F.col("x"))) == [str(uuid.uuid5(uuid.NAMESPACE_DNS, n)) for n in names]


def test_dates(spark):
    samples = ["2024-01-02T03:04:05Z", "2024-01-02T03:04:05+02:00", "2024-01-02 03:04:05", "2024-01-02", "31.02.2024 25:00", "0000-00-00", "", None, "2024-1-2", "2024"]
    found = values(spark, samples, F.date_format(dates.parse_iso(F.col("x")), "yyyy-MM-dd HH:mm:ss"))
    assert found == ["2024-01-02 03:04:05", "2024-01-02 01:04:05", "2024-01-02 03:04:05", "2024-01-02 00:00:00"] + [None] * 6


@pytest.mark.parametrize(
    "now, interval, clock, days, expected",
    [
        ("2024-07-01 10:00:00", "hourly", None, None, "2024-07-01 11:00:00"),
        ("2024-07-01 10:00:00", "daily", "10:00", None, "2024-07-01 10:00:00"),
        ("2024-07-01 10:00:01", "daily", "10:00", None, "2024-07-02 10:00:00"),
        ("2024-07-01 10:00:01", "weekly", "10:00", "0", "2024-07-08 10:00:00"),
        ("2024-07-07 10:00:01", "weekly", "10:00", "0,2", "2024-07-08 10:00:00"),
        ("2024-07-01 09:00:00", "weekly", "10:00", "4", "2024-07-01 10:00:00"),
        ("2024-07-01 11:00:00", "weekly", "10:00", "", None),
        ("2024-07-01 11:00:00", "daily", "7", None, None),
        ("2024-07-01 11:00:00", "never", "10:00", None, None),
    ],
)
def test_next_run(spark, now, interval, clock, days, expected):
    row = spark.createDataFrame([(now, interval, clock, days)], "now string, i string, c string, d string")
    run = dates.next_run(F.col("now").cast("timestamp"), F.col("i"), F.col("c"), text.split_numbers(F.col("d")))
    assert row.select(F.date_format(run, "yyyy-MM-dd HH:mm:ss")).first()[0] == expected


def test_thinking(spark):
    samples = ["a", "<think>x\ny</think> b", "<think>1</think>c<think>2</think>", "<think>open"]
    assert values(spark, samples, text.without_thinking(F.col("x"))) == ["a", "b", "c", "<think>open"]


def test_log_fields(spark):
    samples = ["[2024-01-01 00:00:00] ERROR: a: b", "[t] no level", "plain: x", "  "]
    found = [tuple(r) for r in values(spark, samples, text.log_fields(F.col("x")))]
    assert found == [("2024-01-01 00:00:00", "ERROR", "a: b"), (None, "INFO", "[t] no level"), (None, "INFO", "plain: x"), (None, "INFO", "")]


def test_vectors(spark):
    rows = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0]), (None, [1.0, 0.0])], "a array<float>, b array<float>")
    a, b = F.col("a"), F.col("b")
    found = rows.select(vectors.dot(a, b), vectors.unit(a), F.round(vectors.cosine(a, b), 3)).collect()
    assert [tuple(r) for r in found] == [(24.0, [0.6, 0.8], 0.96), (0.0, [0.0, 0.0], None), (None, None, None)]


def test_models(spark):
    rows = spark.createDataFrame([("Drucker VPN", "der drucker"), ("", "x"), (None, None)], "q string, t string")
    q, t = F.col("q"), F.col("t")
    assert [r[0] for r in rows.select(models.overlap_score(F.coalesce(q, F.lit("")), F.coalesce(t, F.lit("")))).collect()] == [0.5, 0.0, 0.0]
    scorer = models.rerank_with(lambda: lambda queries, texts: [len(a) - len(b) for a, b in zip(queries, texts)])
    assert [r[0] for r in rows.select(scorer(q, t)).collect()] == [0.0, -1.0, 0.0]
    first, second, none = [r[0] for r in rows.select(models.embed(q)).collect()]
    assert len(first) == 16 and abs(sum(x * x for x in first) - 1) < 1e-5 and set(second) == {0.0} and none is None

    def broken():
        def fail(prompts):
            raise ValueError

        return fail

    assert [r[0] for r in rows.select(models.generate(q, broken)).collect()] == ["", "", ""]
