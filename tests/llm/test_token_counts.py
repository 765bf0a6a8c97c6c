"""Token counts against the library that the vocabulary is made for."""

import json
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from marketloom.llm import queries, token_counts

FOLDER = "/root/testdata/sf0.001"
PATH = public_tokenizers.path(token_counts.VOCABULARY)
ODD = [
    None, "", " ", "\n\n  x", "Hello <|endoftext|> x<|endoftext|>y", "<|endoftext|><|endoftext|>", "a" * 1001, "ab" * 77 + "a",
    " " * 33 + "x", "\x1c\x1d \x85  x y　z", "日本語テキスト" * 30, "it's we'll I'D 'tis", "x²³ ½ Ⅷ ٣", "🙂🙂 é ‍",
]


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda texts: [len(x.ids) for x in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.fixture(scope="module")
def merges():
    return token_counts.read_merges(PATH)


def test_query_against_the_library(spark, library):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    sizes = library([row.text for row in docs])
    wanted = [(row.doc_id, len((row.text or "").encode()), n, n > 1024) for row, n in zip(docs, sizes)]
    got = queries.QUERIES["op13_token_counts"](spark, FOLDER)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert sorted(map(tuple, got.collect())) == sorted(wanted)


def test_odd_texts(library, merges):
    assert token_counts.TokenCounter(merges).count(ODD) == library(ODD)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"])), max_size=5))
def test_any_text(library, merges, texts):
    assert token_counts.TokenCounter(merges).count(texts) == library(texts)


def test_every_character(library, merges):
    """Letters, numbers and white space are told apart as the library does."""
    texts = [f"a{chr(code)}1{chr(code)} {chr(code)}" for code in range(0x30000) if not 0xD800 <= code < 0xE000]
    assert token_counts.TokenCounter(merges).count(texts) == library(texts)


def test_long_texts_and_small_bounds(library, merges, monkeypatch):
    rng = random.Random(3)
    letters = "".join(rng.choice("etaoin") for _ in range(20_000))
    texts = [letters, " ".join(letters[k : k + 5] for k in range(0, 20_000, 5)), "short", letters[:70] * 3]
    wanted = library(texts)
    assert token_counts.TokenCounter(merges).count(texts) == wanted
    monkeypatch.setattr(token_counts, "BATCH_CHARS", 100)
    monkeypatch.setattr(token_counts, "CHUNK", 50)
    monkeypatch.setattr(token_counts, "CHUNK_CHARS", 300)
    monkeypatch.setattr(token_counts, "REMEMBERED", 100)
    counter = token_counts.TokenCounter(merges)
    assert counter.count(texts) == wanted == counter.count(texts)
    assert len(counter.known) <= 100


def test_frames(spark, library):
    rows = [(k, text, "x") for k, text in enumerate(ODD)] + [(None, "a b", "y"), (None, "a b", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, N_Tokens string")
    got = token_counts.count_tokens(docs, limit=2)
    assert got.columns == ["doc_id", "text", "N_Tokens", "n_tokens_", "n_bytes", "over_limit"]
    sizes = library([row[1] for row in rows])
    wanted = [(*row, n, len((row[1] or "").encode()), n > 2) for row, n in zip(rows, sizes)]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, wanted))
    assert token_counts.count_tokens(docs.limit(0)).collect() == []


def test_other_vocabularies_are_refused(tmp_path):
    with pytest.raises(ValueError):
        token_counts.read_merges(public_tokenizers.path("word_bpe_49k.json"))
    with open(PATH, encoding="utf-8") as file:
        content = json.load(file)
    content["model"]["merges"] = content["model"]["merges"][:0]
    path = tmp_path / "bytes.json"
    path.write_text(json.dumps(content), encoding="utf-8")
    assert token_counts.TokenCounter(token_counts.read_merges(str(path))).count(["abc é"]) == [6]
