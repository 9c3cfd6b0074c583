"""Phrase mining beside a version that counts every phrase as text."""

import re
from collections import Counter

import numpy as np
import pytest

from nearfield.llm import phrases

SCHEMA = "doc_id bigint, text string, lang string, fp int, phrase string, n int, doc string"


def brute(docs, min_count, most, percent, top):
    counts, totals = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for size in range(1, most + 1):
                for i in range(len(words) - size + 1):
                    counts[lang, tuple(words[i : i + size])] += 1
    candidates = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= min_count}
    out = {}
    for (lang, words), a in candidates.items():
        longer = [
            b for (other, ws), b in candidates.items() if other == lang and len(ws) > len(words)
            and any(ws[i : i + len(words)] == words for i in range(len(ws)))
        ]
        if any(100 * b >= percent * a for b in longer):
            continue
        cuts = []
        for k in range(1, len(words)):
            l, r = counts[lang, words[:k]], counts[lang, words[k:]]
            cuts.append((1_000_000 * a * a // (l * r), k, l, r))
        score, _, l, r = min(cuts)
        out.setdefault(lang, []).append((" ".join(words), a, l, r, totals[lang], score))
    found = []
    for lang, rows in out.items():
        rows.sort(key=lambda x: (-x[5], -x[1], x[0].encode()))
        found += [(lang, i + 1, *row) for i, row in enumerate(rows[:top])]
    return sorted(found)


def make_docs(seed=3):
    rng = np.random.default_rng(seed)
    words = ["new", "York", "is", "a", "á", "city", "big", "the", "x\x1cy", "日本"]
    docs = []
    for i in range(60):
        picked = list(rng.choice(words, rng.integers(1, 80)))
        for at in rng.integers(0, len(picked), len(picked) // 4):
            picked[at] = ["New York", "new\tyork  is", "a big  city", ".", "is. A", "the\r\nend!"][at % 6]
        docs.append((" ".join(picked), ["en", None, "und", "é"][i % 4]))
    docs += [docs[0]] * 12 + [(None, "en"), ("", "en"), (" . \n", None), ("one", "zz"), ("w" * 5000 + " a", "en")]
    return docs


def given(spark, docs):
    rows = [(i // 2, t, l, 1, "x", 2, "y") for i, (t, l) in enumerate(docs)]
    rows = [(None, *r[1:]) if i % 11 == 0 else r for i, r in enumerate(rows)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.mark.parametrize(
    "least, most, percent, top, bits", [(10, 3, 50, 2000, 64), (3, 4, 80, 15, 64), (4, 3, 100, 2000, 6)]
)
def test_phrases(spark, least, most, percent, top, bits):
    docs = make_docs()
    found = phrases.mine_phrases(given(spark, docs), least, most, percent, top, bits)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in found.collect()) == brute(docs, least, most, percent, top)


def test_no_phrases(spark):
    nothing = phrases.mine_phrases(spark.createDataFrame([], SCHEMA))
    assert nothing.count() == 0
    assert phrases.mine_phrases(given(spark, [("a b", "en")])).count() == 0


def test_packing_of_counts():
    rng = np.random.default_rng(1)
    for size, limit in ((1, 1 << 60), (500, 1 << 62), (500, 900)):
        fp = rng.integers(0, limit, size).astype(np.uint64) * np.uint64(3)
        mark = rng.integers(0, 5, size).astype(np.uint64)
        doc, n = rng.integers(0, 1 << 32, size), rng.integers(1, 4, size)
        rows = phrases._grouped(fp, mark, doc, n)
        assert all((a == b).all() for a, b in zip(phrases._unpack(phrases._pack(*rows)), rows))
        assert rows[3].sum() == n.sum()


def test_fingerprints_follow_words_not_places(monkeypatch):
    texts = [b"a b", b"xx A\t b", b"", b"q" * 70_000 + b" a b"]
    words = phrases.read_words(texts)
    assert words.text.tolist() == [0, 0, 1, 1, 1, 3, 3, 3]
    for prints in words.prints:
        assert prints[0] == prints[3] == prints[6] and prints[1] == prints[4] == prints[7]
        assert len(set(prints.tolist())) == 4
    # A long text is hashed in chunks with the same result.
    monkeypatch.setattr(phrases, "CHUNK", 64)
    long = b"some words and more. " * 40_000
    many = phrases.read_words([long])
    assert len(many.piece) == 160_000 and many.piece[-1] == 39_999
    assert len(set(many.prints[0].tolist())) == 4
