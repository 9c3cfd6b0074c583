import random
import zlib

import numpy as np

from nearfield.llm import common, maxent
from nearfield.llm.encoding import WordCoder
from nearfield.llm.queries import WORD_BPE


def test_a_worker_keeps_the_words_of_one_operator():
    pieces, coders = {}, {}
    first = common.kept(pieces, "a", lambda key: [key])
    assert common.kept(pieces, "a", lambda key: [key]) is first
    common.kept(coders, "b", lambda key: [key])
    assert not pieces and list(coders) == ["b"]
    common.kept(pieces, "a", lambda key: [key])
    assert not coders and list(pieces) == ["a"]


def test_new_words_of_small_letters_go_to_the_model_alone():
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyzéóñüß"
    words = ["".join(rng.choices(letters, k=rng.randint(1, 12))) + rng.choice(["", "", ",", "!?"]) for _ in range(3000)]
    odd = ["Don't É.T. cafe\u0301 ÉTÉ İstanbul ﬁn x² a<|endoftext|>b 3rd", "<|ENDOFTEXT|> Ab,c", "", "µm ª º ĳ ÿþ"]
    texts = [" ".join(words).encode(), " ".join(words[::-1]).title().encode(), *(t.encode() for t in odd), b"\xff\xfea b\xc3"]
    coder = WordCoder(WORD_BPE)
    want = [coder.encode_text(t) for t in texts]
    calls, library = [], coder.encode_text
    coder.encode_text = lambda text: calls.append(text) or library(text)
    assert coder.encode_all(texts[:1]) == want[:1]
    assert len(calls) <= 2  # the marks, not the words
    assert coder.encode_all(texts) == want


def test_the_share_of_one_class_is_that_among_all_classes():
    rng = np.random.default_rng(5)
    weights, bias = rng.normal(size=(64, 8)).astype(np.float32), rng.normal(size=8).astype(np.float32)
    at, label = rng.integers(0, 64, (3, 500)), rng.integers(0, 8, 500)
    every = maxent.class_log_probs(weights, bias, at)
    assert np.array_equal(maxent.label_log_probs(weights, bias, at, label), every[np.arange(500), label])


def test_new_words_of_capitals_and_other_scripts():
    rng = random.Random(4)
    letters = "abcxyzABCXYZéóñüßÉÓÑÜ"
    words = ["".join(rng.choices(letters, k=rng.randint(1, 9))) + rng.choice(["", "", ".", "?!"]) for _ in range(2000)]
    other = "Привет МИР, мир! 東京都 Ελληνικά, Привет. Kelvin Ångstr x1y мир".split()
    coder = WordCoder(WORD_BPE, limit=3000)
    texts = [" ".join(words[at : at + 40] + other).encode() for at in range(0, 2000, 40)]
    want = [coder.encode_text(t) for t in texts]
    calls, library = [], coder.encode_text
    coder.encode_text = lambda text: calls.append(text) or library(text)
    assert coder.encode_all([" ".join(words).encode()]) == [coder.encode_text(" ".join(words).encode())]
    assert len(calls) <= 4  # the marks and the text itself, not the words with capitals
    for _ in range(2):
        assert coder.encode_all(texts) == want
    assert not coder.late


def test_token_codes_hold_rank_hash_and_class():
    params = maxent.MaxentParams()
    words = [b"", b"the", b"rare,", b"the", b"common"] * 3 + [b"w%d" % i for i in range(50)]
    codes = maxent.TokenClasses([b"", b"the"], params, limit=10, frequent=[b"common", b"the"])
    for _ in range(2):
        coded = codes.coded(words)
        assert [int(h) for h in maxent.hashes_of(coded)] == [zlib.crc32(w) for w in words]
        assert [int(r) for r in maxent.ranks_of(coded)[:5]] == [0, 2, 0, 2, 1]
        assert [int(c) for c in maxent.classes_of(coded)[:2]] == [0, 1]
        assert (maxent.classes_of(coded)[2:3] >= params.own_classes).all()


def test_sums_of_runs_are_those_of_reduceat():
    rng = np.random.default_rng(6)
    rows = rng.normal(size=(400, 8)).astype(np.float32)
    for sizes in ([1], [1, 2, 3, 8, 9, 30, 1], rng.integers(1, 12, 60)):
        size = np.asarray(sizes)
        first, at = np.cumsum(size) - size, rng.integers(0, 400, size.sum())
        assert np.array_equal(maxent._sums_of_runs(rows, at, first, size), np.add.reduceat(rows[at], first, axis=0))
