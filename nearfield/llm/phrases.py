"""Phrase collocations: word sequences met more often than their parts suggest.

Rabin-Karp fingerprints stand for word sequences: prefix polynomials over the
bytes of a text give the fingerprint of every word, polynomials over words that
of every sequence. Tasks count fingerprints with a pointer to one document that
holds each, the shuffle adds the counts up, and only sequences that prove
frequent are looked up by their pointer, compared with the text there, and
spelled out. Sequences of n words are counted after those of n - 1: one whose
parts are not frequent cannot be.

General over ``doc_id, text, lang``: the library's own records hold no text.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from nearfield.operators.knn import top_per
from nearfield.runtime import materialize

#: Word sequences a task holds before it sends their counts.
FLUSH = 500_000
#: Bytes of text hashed at a time; a longer word makes a longer chunk.
CHUNK = 1 << 17
#: Bytes of texts that are split together; a longer text is alone.
SLICE_BYTES = 1 << 20
#: Bytes of text per group of fingerprints that are added up together.
GROUP_BYTES = 8 << 20
#: Bits of a filter for frequent fingerprints: so many per fingerprint, and at most.
FILTER_BITS, MOST_BITS = 32, 1 << 28

_MIX = np.uint64(0xFF51AFD7ED558CCD)
_BASES = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93], np.uint64)
_SEED = np.array([0x2545F4914F6CDD1D, 0x632BE59BD9B4E019], np.uint64)

# 0: a word's byte, 1: space between words, 2: end of a piece.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2

COUNT_SCHEMA = "fp bigint, mark bigint, n bigint, doc bigint"


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(33))) * _MIX
    return values ^ (values >> np.uint64(29))


def _byte_table(which: int) -> np.ndarray:
    """A 64-bit number for every byte, capital letters as small ones."""
    letters = np.arange(256, dtype=np.uint64)
    letters[65:91] += np.uint64(32)
    return _mixed(_mixed((letters + np.uint64(1)) * _SEED[which]))


_TABLES = [_byte_table(0), _byte_table(1)]


class _Powers:
    """Powers of the bases and of their inverses modulo 2**64, as far as asked for."""

    def __init__(self):
        self.size = 0

    def upto(self, size: int) -> None:
        if size <= self.size:
            return
        self.size = max(size, CHUNK + 1)
        self.up, self.down = [], []
        for base in _BASES.tolist():
            inverse = pow(base, -1, 1 << 64)
            for kept, factor in ((self.up, base), (self.down, inverse)):
                steps = np.full(self.size, factor, np.uint64)
                steps[0] = 1
                kept.append(np.cumprod(steps))


_POWERS = _Powers()


@dataclass
class Words:
    """The words of some texts: fingerprints, piece numbers, texts and places in the bytes."""

    prints: list[np.ndarray]
    piece: np.ndarray
    text: np.ndarray
    start: np.ndarray
    end: np.ndarray


def _cut(data: np.ndarray, at: int) -> int:
    """The end of the chunk that starts at ``at``: past a byte that belongs to no word."""
    end, look = min(at + CHUNK, len(data)), 1 << 10
    while end < len(data):
        # Backwards from the end first; where one word fills the chunk, onwards from there.
        low = max(at, end - look)
        tail = np.flatnonzero(_KIND[data[low:end]])
        if len(tail):
            return low + int(tail[-1]) + 1
        if low == at:
            end = min(end + CHUNK, len(data))
        look *= 2
    return end


def read_words(texts: list[bytes]) -> Words:
    """Split texts into pieces and words and fingerprint every word."""
    joined = np.frombuffer(b"\n".join(texts), np.uint8)
    owner_starts = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]]) if texts else np.zeros(0, np.int64)
    found, pieces, at = [], 0, 0
    while at < len(joined):
        end = _cut(joined, at)
        part = joined[at:end]
        kind = np.take(_KIND, part)
        inside = np.zeros(len(part) + 2, bool)
        np.equal(kind, 0, out=inside[1:-1])
        # Edges alternate: into a word, out of it.
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        start, stop = edges[0::2], edges[1::2]
        ends = np.flatnonzero(kind == 2)
        _POWERS.upto(len(part) + 1)
        prints, prefix = [], np.zeros(len(part) + 1, np.uint64)
        for which in (0, 1):
            terms = np.take(_TABLES[which], part)
            terms *= _POWERS.up[which][: len(part)]
            np.cumsum(terms, out=prefix[1:])
            prints.append(_mixed((prefix[stop] - prefix[start]) * _POWERS.down[which][start]))
        found.append((*prints, np.searchsorted(ends, start) + pieces, start + at, stop + at))
        pieces += len(ends)
        at = end
    empty = np.zeros(0, np.int64)
    columns = [np.concatenate(c) for c in zip(*found)] if found else [empty.view(np.uint64)] * 2 + [empty] * 3
    first, second, piece, start, end = columns
    text = np.searchsorted(owner_starts, start, side="right") - 1
    return Words([first, second], piece, text, start, end)


def _places(words: Words, size: int) -> np.ndarray:
    """First words of all sequences of ``size`` words inside pieces."""
    count = len(words.piece) - size + 1
    return np.flatnonzero(words.piece[: max(0, count)] == words.piece[size - 1 :][: max(0, count)])


def _prints(words: Words, seeds: list[np.ndarray], at: np.ndarray, size: int, which: int) -> np.ndarray:
    """One of the two fingerprints of the sequences of ``size`` words from ``at``; of a language for 0."""
    value = seeds[which][words.text[at]] + np.uint64(size)
    for step in range(size):
        value = value * _BASES[which] + words.prints[which][at + step]
    return _mixed(value)


def _language_seeds(languages: list[str]) -> list[np.ndarray]:
    """One number per text and fingerprint that stands for its language."""
    known = {}
    for name in set(languages):
        data = np.frombuffer(name.encode(), np.uint8).astype(np.int64)
        known[name] = [
            int(_mixed((_TABLES[w][data] * np.arange(1, len(data) + 1, dtype=np.uint64)).sum(keepdims=True))[0])
            for w in (0, 1)
        ]
    return [np.array([known[name][w] for name in languages], np.uint64) for w in (0, 1)]


def _slices(batch: pa.RecordBatch, most: int = SLICE_BYTES):
    """Consecutive rows with about ``most`` bytes of text at a time."""
    sizes = pc.binary_length(batch.column("_text")).to_numpy()
    heads = np.flatnonzero(np.diff(np.cumsum(sizes.astype(np.int64)) // most, prepend=-1))
    for start, end in zip(heads, [*heads[1:], batch.num_rows]):
        yield batch.slice(start, end - start)


def _rows(docs: DataFrame) -> DataFrame:
    """``lang`` (null: ``und``), the text as bytes, and ``doc``, what a pointer says of a document."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = docs.select(
        "doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text.alias("_text")
    )
    doc = F.xxhash64("doc_id", "lang", "_text").bitwiseAND(F.lit(0xFFFFFFFF)).alias("doc")
    return rows.select("lang", "_text", doc)


def _shrink(bits: int, prints: np.ndarray) -> np.ndarray:
    """Fingerprints of ``bits`` bits, kept in the upper ones."""
    return prints if bits >= 64 else prints & ~np.uint64((1 << (64 - bits)) - 1)


def _grouped(fp, mark, doc, n):
    """Rows with equal (fp, mark) as one, in order of fp: counts added, the smallest doc."""
    order = np.argsort(fp)
    if len(fp):
        f, m = fp[order], mark[order]
        if np.any((f[1:] == f[:-1]) & (m[1:] != m[:-1])):
            order = np.lexsort((mark, fp))
    fp, mark = fp[order], mark[order]
    fresh = np.ones(len(fp), bool)
    fresh[1:] = (fp[1:] != fp[:-1]) | (mark[1:] != mark[:-1])
    heads = np.flatnonzero(fresh)
    if not len(heads):
        return fp, mark, doc[order], n[order]
    return fp[heads], mark[heads], np.minimum.reduceat(doc[order], heads), np.add.reduceat(n[order], heads)


class _Filter:
    """A table of bits that lets all frequent fingerprints pass, and some others."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, np.uint64(len(bits) * 8 - 1)

    def __call__(self, prints: np.ndarray) -> np.ndarray:
        at = _mixed(prints) & self.mask
        return (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def frequent_filter(frequent: DataFrame) -> np.ndarray:
    """The filter of all ``fp`` of a table, made in tasks; at most ``MOST_BITS`` bits, 32 MB, in all.

    Above that size it grows fuller and lets more pass, which costs room later and changes no result.
    """
    bits = 1 << 16
    wanted = FILTER_BITS * frequent.count()
    while bits < min(wanted, MOST_BITS):
        bits *= 2
    mask, piece = np.uint64(bits - 1), min(bits // 8, 1 << 16)

    def mark(batches):
        for batch in batches:
            at = _mixed(batch.column("fp").to_numpy().view(np.uint64)) & mask
            byte = (at >> np.uint64(3)).astype(np.int64)
            for number in np.unique(byte // piece):
                own = byte // piece == number
                part = np.zeros(piece, np.uint8)
                np.bitwise_or.at(part, byte[own] % piece, np.uint8(1) << (at[own] & np.uint64(7)).astype(np.uint8))
                yield pa.record_batch([pa.array([int(number)]), pa.array([part.tobytes()])], names=["piece", "part"])

    def unite(group: pa.Table) -> pa.Table:
        parts = [np.frombuffer(p, np.uint8) for p in group.column("part").to_pylist()]
        united = reduce(np.bitwise_or, parts).tobytes()
        return pa.table([group.column("piece").slice(0, 1), pa.array([united])], names=["piece", "part"])

    schema = "piece bigint, part binary"
    table = np.zeros(bits // 8, np.uint8)
    marked = frequent.select("fp").mapInArrow(mark, schema).groupBy("piece").applyInArrow(unite, schema)
    for number, part in marked.collect():
        table[number * piece : (number + 1) * piece] = np.frombuffer(part, np.uint8)
    return table


def _pack(fp, mark, doc, n) -> bytes:
    """Sorted fingerprints as steps of as few bytes as the largest needs; counts above one apart."""
    steps = np.diff(fp, prepend=np.uint64(0))
    width = max(1, (int(steps[1:].max()).bit_length() + 7) // 8) if len(fp) > 1 else 1
    many = np.flatnonzero(n > 1)
    head = np.array([len(fp), width, len(many), int(fp[0])], "<u8")
    body = np.ascontiguousarray(steps[1:].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width])
    parts = [head, body, mark.astype("<u8"), doc.astype("<u4"), many.astype("<u4"), n[many].astype("<u8")]
    return b"".join(p.tobytes() for p in parts)


def _unpack(blob: bytes):
    count, width, many, first = (int(x) for x in np.frombuffer(blob, "<u8", 4))
    at = 32
    steps = np.zeros((count, 8), np.uint8)
    steps[1:, :width] = np.frombuffer(blob, np.uint8, (count - 1) * width, at).reshape(-1, width)
    at += (count - 1) * width
    values = steps.view("<u8").ravel().astype(np.uint64)
    values[0] = first
    mark = np.frombuffer(blob, "<u8", count, at).astype(np.uint64)
    doc = np.frombuffer(blob, "<u4", count, at + 8 * count).astype(np.int64)
    at += 12 * count
    n = np.ones(count, np.int64)
    n[np.frombuffer(blob, "<u4", many, at)] = np.frombuffer(blob, "<u8", many, at + 4 * many)
    return np.cumsum(values), mark, doc, n


def count_sequences(
    docs: DataFrame, size: int, min_count: int, range_bits: int, known: np.ndarray | None = None, bits: int = 64
) -> DataFrame:
    """Frequent sequences of ``size`` words: ``fp, mark, n, doc``.

    With single words come the languages, as sequences without words that are
    met once per word.

    ``known`` is the filter of the frequent sequences with one word less; only
    sequences whose first and last words pass it are sent. Counts are added up
    in the task, packed by the upper ``range_bits`` bits of the fingerprint, and added
    up per range (see ``range_bits_of``). Sequences
    whose fingerprints collide differ in ``mark``, a second fingerprint, and
    are counted apart.
    """
    spark = docs.sparkSession
    rows = _rows(docs)
    shared = None if known is None else spark.sparkContext.broadcast(known)

    def count(batches):
        passes = None if shared is None else _Filter(shared.value)
        held, waiting = [], 0

        def send():
            fp, mark, doc, n = _grouped(*(np.concatenate(c) for c in zip(*held)))
            owner = (fp >> np.uint64(64 - range_bits)).astype(np.int64) if range_bits else np.zeros(len(fp), np.int64)
            heads = np.flatnonzero(np.diff(owner, prepend=-1))
            blobs = [
                _pack(fp[a:b], mark[a:b], doc[a:b], n[a:b]) for a, b in zip(heads, [*heads[1:], len(fp)])
            ]
            held.clear()
            return pa.record_batch([pa.array(owner[heads], pa.int64()), pa.array(blobs, pa.binary())], names=["range", "counts"])

        for batch in batches:
            for part in _slices(batch):
                words = read_words(part.column("_text").to_pylist())
                seeds = _language_seeds(part.column("lang").to_pylist())
                at = _places(words, size)
                if passes is not None:
                    before = _places(words, size - 1)
                    good = np.zeros(len(words.piece) + 1, bool)
                    good[before] = passes(_shrink(bits, _prints(words, seeds, before, size - 1, 0)))
                    at = at[good[at] & good[at + 1]]
                if not len(at):
                    continue
                docs_of = part.column("doc").to_numpy().astype(np.uint32)[words.text]
                for length in (0, 1) if size == 1 else (size,):
                    fp, mark = (_prints(words, seeds, at, length, which) for which in (0, 1))
                    held.append(_grouped(_shrink(bits, fp), mark, docs_of[at], np.ones(len(at), np.int64)))
                    waiting += len(held[-1][0])
                if waiting > FLUSH:
                    yield send()
                    waiting = 0
        if held:
            yield send()

    def add(group: pa.Table) -> pa.Table:
        parts = [_unpack(blob) for blob in group.column("counts").to_pylist()]
        fp, mark, doc, n = _grouped(*(np.concatenate(c) for c in zip(*parts)))
        often = n >= min_count
        columns = [fp[often].view(np.int64), mark[often].view(np.int64), n[often], doc[often]]
        return pa.table([pa.array(c) for c in columns], names=["fp", "mark", "n", "doc"])

    packed = rows.mapInArrow(count, "range bigint, counts binary")
    return materialize(packed.groupBy("range").applyInArrow(add, COUNT_SCHEMA), f"phrases-{size}")


def range_bits_of(docs: DataFrame) -> int:
    """How many bits name the ranges: their number grows with the texts, so each fits in a task."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(0, int(total // GROUP_BYTES).bit_length())


_SPELLED = "fp bigint, mark bigint, lang string, size int, phrase string, lefts array<bigint>, rights array<bigint>, inner array<bigint>, whole array<bigint>"


def spell(docs: DataFrame, frequent: DataFrame, sizes: range, bits: int = 64) -> DataFrame:
    """The phrases behind frequent fingerprints, read where their pointers lead.

    Result ``fp, mark, lang, size, phrase``, the fingerprints of what is left
    and right of every cut (``lefts``, ``rights``) and of all shorter sequences
    inside (``inner``), each as a pair ``fp, mark`` in a row; ``whole`` is the pair
    of the language. A document that
    shares a pointer by chance is read too; only sequences of which both
    fingerprints agree are taken.
    """
    wanted = frequent.groupBy("doc").agg(F.collect_list(F.struct("fp", "mark")).alias("_wanted"))
    rows = _rows(docs).join(wanted, "doc").select("lang", "_text", "_wanted")

    def read(batches):
        for batch in batches:
            for part in _slices(batch):
                yield from _spelled(part, sizes, bits)

    found = rows.mapInArrow(read, _SPELLED)
    return found.dropDuplicates(["fp", "mark"])


def _spelled(part: pa.RecordBatch, sizes: range, bits: int):
    texts = part.column("_text").to_pylist()
    languages = part.column("lang").to_pylist()
    joined = b"\n".join(texts)
    words, seeds = read_words(texts), _language_seeds(languages)
    every = {s: _places(words, s) for s in range(sizes.stop)[1:]}
    every[0] = every[1]
    prints = {}
    for s, at in every.items():
        # Fingerprints by first word; a place without a sequence of that size is never asked for.
        table = np.zeros((len(words.piece), 2), np.uint64)
        table[at, 0], table[at, 1] = _shrink(bits, _prints(words, seeds, at, s, 0)), _prints(words, seeds, at, s, 1)
        prints[s] = table.view(np.int64)
    lists = part.column("_wanted")
    offsets, flat = lists.offsets.to_numpy(), lists.values
    asked = np.stack([flat.field(n).to_numpy() for n in ("fp", "mark")], axis=1)
    asked_text = np.repeat(np.arange(len(texts)), np.diff(offsets))
    asked = asked[offsets[0] : offsets[-1]]
    pair = np.dtype([("text", "<i8"), ("fp", "<i8"), ("mark", "<i8")])

    def keyed(text, both):
        out = np.empty(len(text), pair)
        out["text"], out["fp"], out["mark"] = text, both[:, 0], both[:, 1]
        return out

    questions = np.unique(keyed(asked_text, asked))
    out = []
    for s in sizes:
        at = every[s]
        own = keyed(words.text[at], prints[s][at])
        # Most sequences of a text are not asked for; the first fingerprint alone tells.
        likely = np.flatnonzero(np.isin(own["fp"], questions["fp"]))
        hit = likely[np.isin(own[likely], questions)]
        _, first = np.unique(own[hit], return_index=True)
        for i in at[hit[first]].tolist():
            spans = [joined[words.start[j] : words.end[j]].lower() for j in range(i, i + s)]
            pick = lambda n, j: prints[n][j].tolist()
            out.append(
                (
                    *pick(s, i), languages[words.text[i]], s, b" ".join(spans).decode("utf-8", "replace"),
                    sum((pick(k, i) for k in range(1, s)), []),
                    sum((pick(s - k, i + k) for k in range(1, s)), []),
                    sum((pick(n, j) for n in range(2, s) for j in range(i, i + s - n + 1)), []),
                    pick(0, i),
                )
            )
    schema = ["fp", "mark", "lang", "size", "phrase", "lefts", "rights", "inner", "whole"]
    longs = pa.list_(pa.int64())
    types = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.string(), *[longs] * 4]
    if out:
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types)], names=schema)


def _pairs(name: str):
    """A list ``fp, mark, fp, mark, ...`` as a list of pairs."""
    count = F.size(name) / 2
    at = F.sequence(F.lit(0), (count - 1).cast("int"))
    pair = lambda i: F.struct(F.get(name, 2 * i).alias("fp"), F.get(name, 2 * i + 1).alias("mark"))
    return F.when(count > 0, F.transform(at, pair)).otherwise(F.array().cast("array<struct<fp:bigint,mark:bigint>>"))


def mine_phrases(
    docs: DataFrame, min_count: int = 10, max_words: int = 3, inside_percent: int = 50, top: int = 2000, bits: int = 64
) -> DataFrame:
    """The best collocations of every language: ``lang, rank, phrase, a, l, r, n, score``.

    Capital A-Z count as small. Texts (null: empty) are cut at ``.,;:!?`` and
    line breaks into pieces, those at spaces and tabs into words; a null
    ``lang`` is ``und``. A candidate is a phrase of 2 to ``max_words`` words with ``a``
    occurrences inside pieces, at least ``min_count``, overlaps included. Cut
    after some word it has parts met ``l`` and ``r`` times and the score
    ``floor(1000000 * a * a / (l * r))``; its lowest-scoring cut counts, of
    equal ones the first. A candidate goes if a longer one around it has at
    least ``inside_percent`` percent of its occurrences. ``n`` counts all words of
    the language. Ranked by score and ``a``, high to low, then phrase, by its bytes.

    Repeated rows count each time, whatever their id. Arithmetic is exact up to
    counts of 10 ** 15. Fingerprints have ``bits`` bits and, where they collide,
    a second one of 64. Empty tables and texts give no rows; other columns are
    ignored. A task holds ``FLUSH`` sequences, one range of fingerprints, or a few
    texts with the sequences wanted from them.
    """
    if max_words < 2:
        raise ValueError("max_words must be at least 2")
    counted, known, range_bits = [], None, range_bits_of(docs)
    for size in range(1, max_words + 1):
        frequent = count_sequences(docs, size, min_count, range_bits, known, bits)
        counted.append(frequent)
        if size < max_words:
            known = frequent_filter(frequent)
    counts = reduce(DataFrame.unionByName, counted)
    longer = reduce(DataFrame.unionByName, counted[1:])
    phrases = materialize(spell(docs, longer, range(2, max_words + 1), bits), "phrases")

    own = longer.select("fp", "mark", F.col("n").alias("a"))
    candidates = phrases.join(own, ["fp", "mark"])
    number = counts.select("fp", "mark", "n")
    key = [F.col("fp").alias("_fp"), F.col("mark").alias("_mark")]

    def parts(column, name):
        rows = candidates.select(*key, F.posexplode(_pairs(column)).alias("cut", "_p"))
        rows = rows.select("_fp", "_mark", "cut", F.col("_p.fp").alias("fp"), F.col("_p.mark").alias("mark"))
        return rows.join(number, ["fp", "mark"]).select("_fp", "_mark", "cut", F.col("n").alias(name))

    huge = lambda column: column.cast("decimal(38,0)")
    cuts = parts("lefts", "l").join(parts("rights", "r"), ["_fp", "_mark", "cut"])
    cuts = cuts.join(candidates.select(*key, "a"), ["_fp", "_mark"])
    square = F.lit(1_000_000).cast("decimal(7,0)") * F.col("a").cast("decimal(15,0)") * F.col("a").cast("decimal(15,0)")
    product = F.col("l").cast("decimal(15,0)") * F.col("r").cast("decimal(15,0)")
    cuts = cuts.withColumn("_square", huge(square)).withColumn("_product", huge(product))
    cuts = cuts.withColumn("score", F.expr("_square div _product").cast("bigint"))
    best = cuts.groupBy("_fp", "_mark").agg(F.min(F.struct("score", "cut", "l", "r")).alias("_best"))

    inside = candidates.select(F.col("a").alias("_longer"), F.explode(_pairs("inner")).alias("_p"))
    inside = inside.groupBy(F.col("_p.fp").alias("fp"), F.col("_p.mark").alias("mark")).agg(F.max("_longer").alias("_longer"))
    kept = candidates.join(inside, ["fp", "mark"], "left").filter(
        f"_longer is null or 100 * _longer < {inside_percent} * a"
    )
    scored = kept.join(best, (F.col("fp") == F.col("_fp")) & (F.col("mark") == F.col("_mark"))).select(
        "lang", "phrase", "a", "whole", F.col("_best.l").alias("l"), F.col("_best.r").alias("r"),
        F.col("_best.score").alias("score"), (-F.col("_best.score")).alias("_s"), (-F.col("a")).alias("_a"),
    )
    ranked = top_per(scored, ["lang"], ["_s", "_a", "phrase"], top)
    words = number.select(F.array("fp", "mark").alias("whole"), F.col("n").alias("words"))
    # At most ``top`` rows per language are left.
    return ranked.join(words, "whole").select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", F.col("words").alias("n"), "score"
    )
