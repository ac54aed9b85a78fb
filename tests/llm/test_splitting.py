import random

from threadloom.llm.splitting import renumber, split_oversized, split_text


def rejoin(pieces):
    """The pieces without their overlaps; each overlap is the longest that the operator could have made."""
    text = pieces[0]
    for piece in pieces[1:]:
        text = next(text + piece[n:] for n in range(200, -1, -1) if len(piece) > n and text.endswith(piece[:n]))
    return text


def test_round_trip_and_limits():
    rng = random.Random(7)
    for kind in range(60):
        alphabet = ["ab", "word ", "Satz. ", "\n", "\n\n", "ü", "。", "漢", " "] if kind % 3 else ["x"]
        text = "".join(rng.choice(alphabet) + str(rng.randrange(999)) * (kind % 2) for _ in range(rng.randrange(1500, 4000)))
        pieces = split_text(text)
        assert all(len(p) <= 1800 for p in pieces)
        for before, after in zip(pieces, pieces[1:]):
            assert any(before.endswith(after[:n]) for n in range(1, 201))
        if kind % 2 and kind % 3:
            assert rejoin(pieces) == text


def test_natural_boundaries():
    text = ("Ein Satz mit Worten. " * 40 + "\n\n") * 5
    pieces = split_text(text)
    assert pieces[0].endswith("\n\n") and all(p.startswith("Ein") for p in pieces)
    assert split_text("y" * 1800) == ["y" * 1800]
    assert [len(p) for p in split_text("z" * 1801)] == [1600, 401]


def test_rows(spark):
    rows = [("a", "kurz", 1, 5), ("b", None, 2, 5), ("c", "", 3, 5), ("d", "lang " * 1000, 4, 5), ("d", "lang " * 1000, 4, 5)]
    df = spark.createDataFrame(rows, "id string, text string, n_pieces int, chunk_index int")
    got = split_oversized(df, "text").collect()
    assert sorted(r["id"] for r in got if r["n_pieces"] == 1) == ["a", "b", "c"]
    assert {r["text"] for r in got if r["id"] == "b"} == {None}
    assert sum(r["id"] == "d" for r in got) == 2 * len(split_text("lang " * 1000))
    assert split_oversized(df.limit(0), "text").count() == 0


def test_renumber(spark):
    rows = [(1, i, f"p{i:05d}") for i in range(9000)] + [(None, 0, "q"), (2, None, "r"), (2, 7, "s")]
    df = spark.createDataFrame(rows, "g long, i int, id string")
    got = {r["id"]: r["i"] for r in renumber(df, ["g"], ["i", "id"], "i").collect()}
    assert [got[f"p{i:05d}"] for i in range(9000)] == list(range(9000))
    assert (got["q"], got["s"], got["r"]) == (0, 0, 1)


def test_numbers_run_on_over_ranges(spark):
    rows = [("a", None, i) for i in range(200)] + [("a", 1, 500), ("b", 2, 0), (None, 1, 1), (None, 0, 2)]
    df = spark.createDataFrame(rows, "g string, k int, id int").repartition(3)
    found = renumber(df, ["g"], ["k", "id"], "k", ranges=7).collect()
    by_group = {}
    for r in found:
        by_group.setdefault(r["g"], []).append((r["k"], r["id"]))
    assert sorted(by_group["a"]) == [(0, 500)] + [(i + 1, i) for i in range(200)]
    assert by_group["b"] == [(0, 0)] and sorted(by_group[None]) == [(0, 2), (1, 1)]


def test_paragraphs_with_carriage_returns():
    paragraphs = [("Satz eins. " * 9).strip() for _ in range(6)]
    pieces = split_text("\r\n\r\n".join(paragraphs), 250, 0)
    assert all(p.startswith("Satz") and p.rstrip().endswith("eins.") and len(p) <= 250 for p in pieces) and len(pieces) == 3
