import os
import random

import pytest

from threadloom.llm import bpe

pytestmark = pytest.mark.skipif(not os.path.exists(os.path.join(bpe.TOKENIZERS, bpe.VOCABULARY)), reason="no vocabulary files")


def texts():
    rng = random.Random(3)
    fixed = ["", "a" * 3000, "<|endoftext|> hi", "\x1c\u0085 　 x", "I'll'd 've", "Straße 12,5 €", "日本語のテキスト", "👨‍👩‍👧"]
    mixed = ["".join(rng.choice("abcdethe sinrg ’–\n\t\r12ßé漢") for _ in range(150)) for _ in range(400)]
    return fixed + mixed


def test_equals_public_library():
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(os.path.join(bpe.TOKENIZERS, bpe.VOCABULARY))
    other.encode_special_tokens = True
    built = bpe.automaton(bpe.vocabulary())
    for text in texts():
        ids = built.encode(text)
        assert ids == other.encode(text, add_special_tokens=False).ids
        assert built.decode(ids) == text


def test_columns(spark):
    df = spark.createDataFrame([(1, "Hallo Welt", 9), (2, "", 9), (3, None, 9)], "doc_id long, text string, ids int")
    rows = {r["doc_id"]: r for r in bpe.token_ids(df, "text").collect()}
    assert rows[2]["ids"] == [] and rows[3]["ids"] == [] and rows[1]["ids"]
    counts = {r["doc_id"]: r["n_tokens"] for r in bpe.token_count(df, "text").collect()}
    assert counts == {1: len(rows[1]["ids"]), 2: 0, 3: 0}
    back = bpe.token_text(bpe.token_ids(df, "text"), "ids", "again")
    assert {r["doc_id"]: r["again"] for r in back.collect()} == {1: "Hallo Welt", 2: "", 3: ""}
    assert bpe.token_ids(df.limit(0), "text").count() == 0
