"""Operators on texts beside brute-force versions, with nulls, ties, copies and empty tables."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.llm import (
    fertility, importance, jaccard, maxent, mixing, packing, tokenids, toxicity, warc,
)
from nearfield.llm.queries import PIECE_BPE, WORD_BPE
from nearfield.runtime import table_path

WORDS = "the of and Anhe onti thest. reing, Straße été 42 <|endoftext|> it's a.b áe %%% HE!!".split()
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, part int, size string"


def make_texts():
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(WORDS, n)) for n in (1, 3, 4, 5, 60, 200, 700, 3000)]
    base = [f"w{i}" for i in range(100)]
    near = [" ".join(base), " ".join(base[:-1] + ["x"]), " ".join(base[:-4] + ["y"])]
    far = " ".join(base[:50] + [f"z{i}" for i in range(60)])
    odd = ["", None, " \n\t ", "one\n\none\ntwo\r\none", "a b c " * 30, texts[5]]
    return texts + near + [far, near[0]] + odd


@pytest.fixture(scope="module")
def texts():
    return make_texts()


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, ["en", "fr", None][i % 3], ["a", "b", None][i % 3], None, 1, "x")
            for i, t in enumerate(texts)]
    rows += [(4, texts[4], "fr", "b", None, 1, "x"), (None, texts[5], None, None, None, 1, "x")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def encoded():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORD_BPE)

    def encode(text):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        return np.array(ids, "<u4")

    return encode


def test_token_ids_round_trip(spark, docs, encoded):
    path = table_path(spark, "ids")
    tokenids.write_lists(tokenids.encode_ids(docs, WORD_BPE), path)
    rows = tokenids.read_ids(spark, path).orderBy("start").collect()
    given = sorted(((r.doc_id, r.text or "") for r in docs.collect()),
                   key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    assert [r.doc_id for r in rows] == [d for d, _ in given]
    total = 0
    for row, (_, text) in zip(rows, given):
        ids = encoded(text)
        assert (row.start, row.n_tokens) == (total, len(ids))
        assert row.ids == ids.tolist()
        total += len(ids)
    crcs = {r.start: r.ids_crc32 for r in tokenids.with_crc(tokenids.read_ids(spark, path)).collect()}
    assert crcs == {r.start: zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in rows}
    some = tokenids.read_ids(spark, path, doc_ids=(3, 4), ids=False)
    assert some.columns == ["doc_id", "start", "n_tokens"] and some.count() == 3


def test_ids_of_added_tokens_in_any_case(tmp_path):
    import json

    from tokenizers import Tokenizer

    from nearfield.llm.encoding import WordCoder

    given = [b"<|ENDOFTEXT|>", b"a <|endoftext|> B", b"x<|EndOfText|>y Abc, DEF!!", b"<|STARTOFTEXT|>. <|startoftext|>x",
             b"Plain TEXT, it's (odd)... x" * 3, "É <|ENDOFTEXT|> Ü".encode()]
    # The same vocabulary without the step that folds the case.
    file = json.load(open(WORD_BPE))
    steps = file["normalizer"]["normalizers"]
    file["normalizer"]["normalizers"] = [s for s in steps if s["type"] != "Lowercase"]
    cased = str(tmp_path / "cased.json")
    json.dump(file, open(cased, "w"))
    for path in (WORD_BPE, cased):
        library, coder = Tokenizer.from_file(path), WordCoder(path)
        for order in (given, given[::-1]):
            got = [np.frombuffer(ids, "<u4").tolist() for ids in coder.encode_all(order)]
            assert got == [library.encode(t.decode(), add_special_tokens=False).ids for t in order]


def test_token_ids_of_nothing(spark, empty):
    path = table_path(spark, "ids")
    tokenids.write_lists(tokenids.encode_ids(empty, WORD_BPE), path)
    assert tokenids.read_ids(spark, path).count() == 0


@pytest.mark.parametrize("limits", [packing.Limits(), packing.Limits(64, 4, 40)])
def test_packing(docs, encoded, limits):
    rows = packing.pack(docs.withColumn("prompt", F.lit(3)), WORD_BPE, limits, prompt_tokens="prompt")
    rows = rows.collect()
    wanted, got = Counter(), Counter()
    for r in docs.collect():
        wanted.update((r.doc_id, at, int(i)) for at, i in enumerate(encoded(r.text)))
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length
        got.update((r.doc_id, r.start + at, int(i)) for at, i in enumerate(ids))
    assert got == wanted
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for group in by.values():
        group.sort(key=lambda r: r.offset)
        ends = list(itertools.accumulate(r.length for r in group))
        assert [r.offset for r in group] == [0, *ends[:-1]]
        assert ends[-1] <= limits.tokens and len(group) <= limits.segments
        assert sum(r.loss_tokens for r in group) <= limits.loss


def test_packing_pads_little(spark, empty):
    rows = spark.range(500).selectExpr("id AS doc_id", "repeat('the of ', cast(id % 90 as int)) AS text")
    sums = packing.pack(rows, WORD_BPE).groupBy("sequence_id").agg(F.sum("length").alias("n"))
    lengths = [r.n for r in sums.collect()]
    assert sum(2048 - n for n in lengths if n & (n - 1)) <= 0.02 * sum(lengths)
    assert packing.pack(empty, WORD_BPE).count() == 0


def test_warc(spark):
    big, other = "x" * 99 + "é", "<p>\r\n\r\nWARC/1.1\r\n\r\n\r\n" + "y" * 200
    given = [(5, "http://a/\r\nX: y", big), (3, None, big), (9, "u", big), (7, "u", other),
             (8, "u", other + "\r\n"), (1, "u", "small"), (2, "u", "small"), (4, "u", None),
             (6, "u", ""), (None, "u", big), (3, None, big)]
    pages = spark.createDataFrame(given, "page_id bigint, url string, html string")
    path = table_path(spark, "warc")
    warc.write_archives(pages.withColumn("refers_to", F.lit(1)), path)
    rows = warc.read_archives(spark, path).collect()
    assert len(rows) == len(given)
    first = {}
    for page, _, html in given:
        if page is not None and len((html or "").encode()) >= 100:
            first[html] = min(page, first.get(html, page))
    want = Counter()
    for page, _, html in given:
        raw = (html or "").encode()
        original = first.get(html)
        revisit = original is not None and original != page
        want[(page, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response",
              original if revisit else None, None if revisit else raw)] += 1
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to,
                   None if r.payload is None else bytes(r.payload)) for r in rows)
    assert got == want
    path = table_path(spark, "warc")
    warc.write_archives(pages.limit(0), path)
    assert warc.read_archives(spark, path).count() == 0


@pytest.mark.parametrize("html", ["<p>\r\n", "\r\n", "<p>\r\n\r\n\r\n", "<p>\r", "<p>\n"])
def test_warc_line_break_at_the_end(spark, html):
    pages = spark.createDataFrame([(1, "u", html)], "page_id bigint, url string, html string")
    path = table_path(spark, "warc")
    warc.write_archives(pages.coalesce(1), path)
    assert [bytes(r.payload) for r in warc.read_archives(spark, path).collect()] == [html.encode()]
    # Archives that are read in one task.
    path = table_path(spark, "warc")
    pages = pages.union(pages.withColumn("page_id", F.lit(2).cast("bigint"))).repartition(2, "page_id")
    warc.write_archives(pages, path)
    warc.write_archives(pages.coalesce(1), f"{path}-one")
    for at in (path, f"{path}-one"):
        rows = warc.read_archives(spark, at).coalesce(1).collect()
        assert sorted((r.page_id, bytes(r.payload)) for r in rows) == [(i, html.encode()) for i in (1, 2)]


def test_fertility(docs, empty):
    got = Counter()
    for r in fertility.quality_rules(docs, PIECE_BPE).collect():
        got[(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)] += 1
        assert not (r.kept and r.base_failed)
    want = Counter()
    for r in docs.collect():
        w, text = words(r.text), r.text or ""
        windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {i + j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(3)}
        lines = [x for x in text.split("\n") if words(x)]
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        want[(r.doc_id, len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"),
              len(lines) - len(set(lines)), len(covered), failed)] += 1
    assert got == want
    assert fertility.quality_rules(empty, PIECE_BPE).count() == 0


def test_fertility_bands_decide(spark):
    rng = np.random.default_rng(3)
    vocabulary = [a + b + c for a in ("pa", "tri", "mo", "len") for b in ("ra", "ti", "so") for c in ("ne", "d", "k")]
    texts = [" ".join(rng.choice(vocabulary, rng.integers(150, 250))) for _ in range(200)]
    junk = [" ".join(rng.choice(vocabulary[:12], 150)) for _ in range(5)]
    rows = [(i, t, "en") for i, t in enumerate(texts + junk)] + [(900 + i, junk[0], "de") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    verdicts = {r.doc_id: r for r in fertility.quality_rules(docs, PIECE_BPE).collect()}
    assert len(verdicts) == len(rows)
    assert all(verdicts[i].kept for i in range(200))
    assert not any(verdicts[i].base_failed or verdicts[i].kept for i in range(200, 205))
    given = fertility.quality_rules(docs, PIECE_BPE, fertility.BANDS).collect()
    assert all(verdicts[i].kept == next(r.kept for r in given if r.doc_id == i) for i in (900, 901, 902))


def test_fertility_measures(spark):
    import sentencepiece

    text = "the of the 中文 été"
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    ids = [i for w in words(text) for i in model.encode(w)]
    row = fertility.fertility(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), PIECE_BPE).first()
    share = [n / len(ids) for n in Counter(ids).values()]
    assert row.n_tokens == len(ids)
    assert row.chars_per_token == pytest.approx(sum(map(len, words(text))) / len(ids))
    assert row.byte_share == pytest.approx(sum(map(model.is_byte, ids)) / len(ids))
    assert row.token_entropy == pytest.approx(-sum(p * math.log2(p) for p in share) / math.log2(len(ids)))


def components(texts):
    sets = []
    for t in texts:
        w = [x.decode() for x in (t or "").encode().lower().split()]
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    label = list(range(len(sets)))
    for a, b in itertools.combinations(range(len(sets)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            old, new = max(label[a], label[b]), min(label[a], label[b])
            label = [new if x == old else x for x in label]
    return list(map(len, sets)), label


@pytest.mark.parametrize("region_rows", [2048, 3])
def test_jaccard_join(spark, texts, empty, region_rows):
    rng = np.random.default_rng(3)
    many = list(texts)
    base = [f"b{i}" for i in range(60)]
    for _ in range(40):  # copies that differ in up to three words, some linked only over others
        copy = list(base)
        for i in rng.integers(0, 60, rng.integers(0, 4)):
            copy[i] = f"c{rng.integers(5)}"
        many.append(" ".join(copy))
    rows = spark.createDataFrame(list(enumerate(many)), "doc_id bigint, text string").repartition(3)
    found = jaccard.near_duplicates(rows, jaccard.JaccardParams(region_rows=region_rows)).collect()
    sizes, label = components(many)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == [
        (i, sizes[i], label[i]) for i in range(len(many))
    ]
    assert jaccard.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("percent", [60, 80, 100])
def test_sketches_lose_no_link(percent):
    rng = np.random.default_rng(5)
    sets = []
    for n in (1, 2, 5, 31, 32, 33, 64, 200, 257, 1000):
        base = rng.integers(0, 2**63, n, dtype=np.uint64)
        for changed in (0, 1, n // 20, n // 10, n // 5, n // 2):
            fresh = rng.integers(0, 2**63, changed + n // 16, dtype=np.uint64)
            sets.append(np.unique(np.concatenate([base[changed:], fresh])))
    sets = [s for s in sets if len(s)]
    sketches = jaccard._Sketches(
        np.array([len(s) for s in sets]), [jaccard._sketch(s) for s in sets], percent
    )
    likely = {frozenset((int(a), int(b))) for a, others in sketches.partners() for b in others}
    linked = set()
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            inside = len(np.intersect1d(a, b))
            if 100 * inside >= percent * (len(a) + len(b) - inside):
                linked.add(frozenset((i, j)))
    assert linked and linked <= likely
    assert len(likely) < len(sets) * len(sets) / 8


def test_jaccard_join_repeated_and_null_ids(docs):
    found = jaccard.near_duplicates(docs).collect()
    assert len(found) == docs.count()
    assert {r.component_id for r in found if r.doc_id is None} == {5}
    assert [r.component_id for r in found if r.doc_id == 4] == [4, 4]


def test_mixing(docs, empty):
    rows = mixing.plan_mix(docs).collect()
    sizes = {}
    for r in docs.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(words(r.text))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    share, total = {}, sum(sizes.values())
    capped = set()
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        share = rest / sum(weight[s] for s in order if s not in capped)
        more = {s for s in order if s not in capped and share * weight[s] >= 3 * sizes[s]}
        if not more:
            break
        capped |= more
    for r in rows:
        target = 3 * sizes[r.source] if r.source in capped else share * weight[r.source]
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target)
        assert r.copies in (math.floor(target / sizes[r.source]), math.ceil(target / sizes[r.source]))
    mixed = mixing.mix(docs)
    assert mixed.count() == sum(r.copies for r in rows)
    assert mixing.mix(docs).count() == mixed.count()
    assert mixing.mix(empty).count() == 0


def test_language_model(spark, docs, texts, empty):
    held = F.col("doc_id") % 4 == 1
    rows = maxent.language_model(docs, held, maxent.MaxentParams(frequent=5)).collect()
    given = docs.collect()
    tokens = {r.text: [w.decode() for w in (r.text or "").encode().lower().split()] + [""] for r in given}
    counts = Counter()
    for r in given:
        if r.doc_id is None or r.doc_id % 4 != 1:
            counts.update(tokens[r.text])
    n, v = sum(counts.values()), len(counts)
    want = sorted(
        (r.doc_id or -1, len(tokens[r.text]), sum(counts[w] > 0 for w in tokens[r.text]),
         round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens[r.text]), 5))
        for r in given
    )
    assert sorted((r.doc_id or -1, r.n_tokens, r.n_known, round(r.base_score, 5)) for r in rows) == want
    assert all(r.train_tokens == n and r.score < 0 for r in rows)
    assert maxent.language_model(empty, held).count() == 0


def test_language_model_learns_history(spark):
    rows = [(i, "red fish swims. " * 40 if i % 2 else "blaue katze singt! " * 40) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    scored = maxent.language_model(docs, F.col("doc_id") < 10).filter("doc_id < 10")
    row = scored.agg(F.sum("score"), F.sum("base_score")).first()
    assert row[0] > 0.8 * row[1]


def labelled(spark):
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(400):
        text = list(rng.choice([f"w{k}" for k in range(80)], 40))
        if i % 4 == 0:
            text[3] = rng.choice(["scum", "moron"])
            text[5] = "muslims" if i % 8 == 0 else text[5]
        rows.append((i, " ".join(text)))
        labels.append((i, int(i % 5 > 0), int(i % 4 == 0)))
    rows += [(1000, "w1 w2 muslims w3"), (1001, "w1 w2 christians w3"), (1002, None), (None, "w1 moron")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    return docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_toxicity(spark):
    docs, labels = labelled(spark)
    gaps = []
    for fairness in (0.0, 50.0):
        params = toxicity.ToxicityParams(fairness=fairness)
        model = toxicity.fit_toxicity(docs, labels.filter("doc_id % 3 > 0"), params)
        score = {r.doc_id: r for r in toxicity.score_toxicity(docs, model).collect()}
        assert len(score) == docs.count()
        held = [(score[i].predicted, int(i % 4 == 0)) for i in range(0, 400, 3)]
        assert sum(a == b for a, b in held) >= 0.97 * len(held)
        gaps.append(abs(score[1000].score - score[1001].score))
        assert score[None].predicted == 1 and 0 <= score[1002].score <= 1
    assert gaps[1] < 0.5 * gaps[0]
    constant = toxicity.fit_toxicity(docs, labels.limit(0))
    assert not constant.weights.any()


def test_importance_resampling(spark, empty):
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for i in range(600):
        text = list(rng.choice([f"w{k}" for k in range(60)], 60))
        if i % 5 == 0:
            text = [w.upper() + "!!" for w in text]
        rows.append((i, " ".join(text), "x"))
        labels.append((i, int(i % 5 > 0)))
    docs = spark.createDataFrame(rows + [(600, None, "x"), (None, "w1 w2", "x")], "doc_id bigint, text string, kept string")
    labels = spark.createDataFrame(labels, "doc_id bigint, quality int").filter("doc_id % 3 = 0")
    kept = {r.doc_id: r.kept for r in importance.resample(docs, labels).collect()}
    good = [kept[i] for i in range(600) if i % 5]
    assert sum(good) >= 0.95 * len(good) and not any(kept[i] for i in range(0, 600, 5))
    again = {r.doc_id: r.kept for r in importance.resample(docs, labels).collect()}
    assert again == kept
    assert importance.resample(empty, labels).count() == 0
