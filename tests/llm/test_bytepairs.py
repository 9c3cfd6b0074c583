"""Byte-level ids beside the library on whole texts, and decoding back."""

from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st

from nearfield.llm import bytepairs
from nearfield.llm.queries import BYTE_RANKS

PATTERN = public_tokenizers.PATTERN
TEXTS = [
    "", None, " ", "a", "It's  the\tend.\n\n  of 42things x <|endoftext|>", "é" * 50 + " \x1c b\x1c c", "日本語 テキスト" * 40,
    "don't DON'T 12'll x's'd   　y", "ab́c 9٣ \U0001f600!", "a" * 3000, " " * 500 + "x", "word " * 20_000, "1a2b" * 900,
]
SCHEMA = "doc_id bigint, text string, ids string, data int, n_tokens int"


@pytest.fixture(scope="module")
def library():
    return bytepairs.encoding(BYTE_RANKS, PATTERN)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", 1, 2) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "x", 1, 2), (None, TEXTS[4], "x", 1, 2)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.mark.parametrize("limit", [bytepairs.PART_CHARS, 5])
def test_ids_and_bytes(docs, library, limit):
    coded = bytepairs.encode_texts(docs, BYTE_RANKS, PATTERN, limit)
    rows = bytepairs.decode_ids(coded, BYTE_RANKS, PATTERN).collect()
    want = Counter((r.doc_id, tuple(library.encode_ordinary(r.text or ""))) for r in docs.collect())
    assert Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in rows) == want
    assert all(r.n_tokens * 4 == len(r.ids) for r in rows)
    assert Counter((r.doc_id, bytes(r.data)) for r in rows) == Counter(
        (r.doc_id, (r.text or "").encode()) for r in docs.collect()
    )


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("abzAZ09 \n\t'!_\x1c\x85 é٣日s-") , max_size=60), st.integers(1, 9))
def test_parts_do_not_change_ids(library, text, limit):
    parts = list(bytepairs.safe_parts(text, limit))
    assert "".join(parts) == text
    assert sum((library.encode_ordinary(p) for p in parts), []) == library.encode_ordinary(text)


def test_a_run_without_a_place_to_cut(library):
    text = "é" * 400_000
    assert list(bytepairs.safe_parts(text, 1000)) == [text]
    assert library.decode_bytes(library.encode_ordinary(text)) == text.encode()
    assert max(map(len, bytepairs.safe_parts("some words 12 " * 50_000, 1000))) < 1100


def test_decoding_parts_of_characters(spark, library):
    ids = library.encode_ordinary("é日😀")
    rows = [(i, np.array(ids[:i], "<u4").tobytes()) for i in range(len(ids) + 1)] + [(99, None)]
    found = bytepairs.decode_ids(spark.createDataFrame(rows, "n int, ids binary"), BYTE_RANKS, PATTERN)
    for row in found.collect():
        assert row.data == (None if row.ids is None else bytearray(library.decode_bytes(ids[: row.n])))
    bad = spark.createDataFrame([(1, np.array([99_999_999], "<u4").tobytes())], "n int, ids binary")
    with pytest.raises(Exception):
        bytepairs.decode_ids(bad, BYTE_RANKS, PATTERN).collect()


def test_no_texts(spark):
    empty = bytepairs.encode_texts(spark.createDataFrame([], SCHEMA), BYTE_RANKS, PATTERN)
    assert bytepairs.decode_ids(empty, BYTE_RANKS, PATTERN).count() == 0
