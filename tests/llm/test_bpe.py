import random

import pytest
from tokenizers import Tokenizer

from tidemark.llm import bpe
from tidemark.llm.queries import QUERIES
from tidemark.plans.tables import table

VOCAB = f"{bpe.TOKENIZER_DIR}/{bpe.VOCABULARY}"


@pytest.fixture(scope="module")
def other():
    t = Tokenizer.from_file(f"{bpe.TOKENIZER_DIR}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


def test_whole_table_equals_the_library(spark, data, other):
    texts = {r["doc_id"]: r["text"] for r in table(spark, data, "documents").collect()}
    got = {r["doc_id"]: r["ids"] for r in QUERIES["p8_ids"](spark, data).collect()}
    assert got.keys() == texts.keys()
    assert all(got[k] == other(t or "") for k, t in texts.items())


@pytest.mark.parametrize(
    "text",
    ["", " ", "a" * 30_000, "ab" * 9_000, "ก" * 4_000, " " * 3_000, "<|endoftext|> x", "I'll 'S don't\r\n\tx  ", "日本語。テスト", "👩‍💻🚀​﻿", "\x00\x01", "1.5e-7"],
    ids=lambda t: repr(t[:8]),
)
def test_special_texts(text, other):
    assert bpe.encode(text, VOCAB) == other(text)


def test_random_texts(other):
    rng = random.Random(5)
    for _ in range(1500):
        s = "".join(rng.choice("abcdeé 日本ที่ไ́‍🚀\n\t 0123.,'\"sS") for _ in range(rng.randint(0, 60)))
        assert bpe.encode(s, VOCAB) == other(s), s


def test_null_empty_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "a b", None), (3, "a b", None)], "doc_id long, text string, ids string")
    got = sorted((r["doc_id"], r["ids"]) for r in bpe.encode_corpus(df).collect())
    assert got == [(1, []), (2, []), (3, [64, 275]), (3, [64, 275])]
    assert bpe.encode_corpus(df.limit(0)).collect() == []
