import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from basinweave.llm import tokenize as T

pytestmark = pytest.mark.skipif(not os.path.exists(T.VOCABULARY), reason="no vocabulary here")
ODD = ["", " ", "\n\n  \t", "don't we'll I'VE", "a" * 3000, "naïve Straße 水文学的 é", "x\x1c\x1dy  z​﻿", "👩‍👩‍👧 🏳️‍🌈", "<|endoftext|>", "१२३ ٤٥", "\r\n\r\n a  b   ", "ſ ʼs ’s", "\x85 "]


@pytest.fixture(scope="module")
def encoder():
    with open(T.VOCABULARY, "rb") as f:
        return T.Encoder(T.read_ranks(f.read()))


@pytest.fixture(scope="module")
def public():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(os.path.join(os.path.dirname(T.VOCABULARY), "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ODD)
def test_same_as_public_library(encoder, public, text):
    assert list(encoder.encode(text)) == public(text)


@settings(max_examples=300, deadline=None)
@given(text=st.text(max_size=60))
def test_any_text(encoder, public, text):
    ids = list(encoder.encode(text))
    assert ids == public(text)
    assert encoder.decode(ids) == text


def plain_merge(piece, ranks):
    """Brute force: the pair of lowest rank, again and again."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not pairs:
            return tuple(ranks[p] for p in parts)
        _, i = min(pairs)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@settings(max_examples=200, deadline=None)
@given(st.text("abcdehilnorst 'é", min_size=1, max_size=40))
def test_queue_against_brute_force(text):
    with open(T.VOCABULARY, "rb") as f:
        ranks = test_queue_against_brute_force.__dict__.setdefault("ranks", None) or T.read_ranks(f.read())
    test_queue_against_brute_force.ranks = ranks
    piece = text.encode()
    assert T.merge_piece(piece, ranks) == (plain_merge(piece, ranks) if piece not in ranks else (ranks[piece],))


def test_corpus(spark, public):
    rows = [(i, t, "k") for i, t in enumerate([*ODD, None, "word " * 20000])]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = {r.doc_id: r.ids for r in T.encode_corpus(df).collect()}
    assert got == {i: public(t) if t else [] for i, t, _ in rows}
    assert T.encode_corpus(df.limit(0)).collect() == []


def test_batches_are_bounded_by_ids(spark, public, monkeypatch):
    rows = [(i, t) for i, t in enumerate(["a b c", None, "", "one two three four five", "x"] * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(T, "MOST_IDS", 4)
    got = {r.doc_id: r.ids for r in T.encode_corpus(df).collect()}
    assert got == {i: public(t) if t else [] for i, t in rows}
