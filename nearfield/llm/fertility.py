"""Quality rules on tokeniser fertility: how well public vocabularies fit a text.

General over ``doc_id, text, lang``: the library's own records hold no texts.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from nearfield.llm.common import WordTable, blobs, kept, offsets_of, segment_sums, slices, text_rows
from nearfield.runtime import materialize

_SYMBOLS = b"#*$%&|<>"
BASE_SCHEMA = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"
)
FERTILITY_SCHEMA = "n_tokens bigint, chars_per_token double, byte_share double, token_entropy double"

# Bands where a language has too few documents for its own: (lowest, highest) characters per token, highest share of
# byte-fallback tokens, lowest token entropy. Entropy is a share of the entropy
# that as many different tokens would have, up to ENTROPY_TOKENS of them.
# Languages in Latin script share one band with room on both sides of running
# text; a language without an entry, or none, takes the band of None.
BANDS = {
    "en": (1.5, 8.0, 0.05, 0.55),
    "de": (1.5, 8.0, 0.05, 0.55),
    "fr": (1.4, 8.0, 0.05, 0.55),
    "es": (1.4, 8.0, 0.05, 0.55),
    None: (1.0, 12.0, 0.25, 0.45),
}
ENTROPY_TOKENS = 256
#: A band of a language's own needs so many different measures.
LEAST_DOCUMENTS = 100
# Per measure: how many times the distance between its quartiles a band reaches
# beyond them, and how far at least. Characters per token get more room, as
# clean texts full of names and numbers lie far out.
MARGINS = {
    "chars_per_token": (8.0, 0.3),
    "byte_share": (1.5, 0.05),
    "token_entropy": (1.5, 0.05),
}


class _Pieces:
    """Per word of a SentencePiece vocabulary: its pieces, byte pieces, characters and symbols."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = len(self.model)
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.size)])
        self.ids = np.zeros(0, np.int64)
        self.used = 0
        self.table = WordTable(self.learn)

    def learn(self, words: list[bytes]):
        texts = [w.decode("utf-8", "replace") for w in words]
        found = self.model.encode(texts, num_threads=1)
        lengths = np.array(list(map(len, found)), np.int64)
        flat = np.fromiter(chain.from_iterable(found), np.int64, int(lengths.sum()))
        offsets = offsets_of(lengths)
        if not self.table:
            self.used = 0
        need = self.used + len(flat)
        if need > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(need, np.int64)])
        self.ids[self.used : need] = flat
        first, self.used = self.used + offsets[:-1], need
        symbols = [len(w) - len(w.translate(None, _SYMBOLS)) for w in words]
        return (
            lengths,
            segment_sums(self.is_byte[flat], offsets).astype(np.int64),
            np.array(list(map(len, texts)), np.int64),
            np.array(symbols, np.int64),
            first,
        )


_LOADED: dict[str, _Pieces] = {}


def _loaded(path: str) -> _Pieces:
    return kept(_LOADED, path, _Pieces)


def _repeated(words: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per text, the words that lie in a 3-word window found twice or more in it."""
    covered = np.zeros(len(words), bool)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    start = np.flatnonzero(owner[:-2] == owner[2:]) if len(words) > 2 else np.zeros(0, np.int64)
    if len(start):
        _, code = np.unique(words, return_inverse=True)
        key = owner[start]
        for shift in range(3):
            # Re-coded at each step, so that the key never outgrows 64 bits.
            key = np.unique(key, return_inverse=True)[1] * (code.max() + 1) + code[start + shift]
        _, which, times = np.unique(key, return_inverse=True, return_counts=True)
        hit = start[times[which] > 1]
        for shift in range(3):
            covered[hit + shift] = True
    return segment_sums(covered, offsets).astype(np.int64)


def _dup_lines(text: bytes) -> int:
    lines = [line for line in text.split(b"\n") if line.strip(b" \t\n\r\x0b\x0c")]
    return len(lines) - len(set(lines))


def fertility(docs: DataFrame, pieces: str, *keep: str) -> DataFrame:
    """Measures of every whole text: ``doc_id``, ``keep``, then BASE_SCHEMA and FERTILITY_SCHEMA.

    ``pieces`` is a SentencePiece vocabulary with byte fallback. Words are runs
    of anything but ASCII white space and are cut into pieces one by one.
    ``chars_per_token`` is code points in words per piece, ``byte_share`` the
    share of byte-fallback pieces, ``token_entropy`` the entropy of the text's
    pieces as a share of log2(min(pieces, ENTROPY_TOKENS)). A null or empty text
    has zeros and null ratios. Nothing is shuffled.
    """
    rows = text_rows(docs, *keep)
    fields = [rows.schema[c].simpleString().split(":", 1) for c in ("doc_id", *keep)]
    schema = ", ".join(f"`{n}` {t}" for n, t in fields) + f", {BASE_SCHEMA}, {FERTILITY_SCHEMA}"
    names = [n for n, _ in fields]
    names += [c.split()[0] for c in f"{BASE_SCHEMA}, {FERTILITY_SCHEMA}".split(", ")]

    def measure(batches):
        vocabulary = _loaded(pieces)
        table = vocabulary.table
        for batch in batches:
            for part in slices(batch):
                texts = blobs(part)
                split = table.prepare([t.split() for t in texts])
                offsets = offsets_of([len(w) for w in split])
                flat = table.numbers(list(chain.from_iterable(split)))
                columns = table.columns or [np.zeros(1, np.int64)] * 5
                sums = [segment_sums(c[flat], offsets).astype(np.int64) for c in columns[:4]]
                tokens, bytes_, chars, symbols = sums
                entropy = _entropy(vocabulary, columns[4][flat], columns[0][flat], offsets)
                full = tokens > 0
                one = np.maximum(tokens, 1)
                measures = [
                    np.diff(offsets),
                    chars,
                    symbols,
                    np.array([_dup_lines(t) for t in texts], np.int64),
                    _repeated(flat, offsets),
                    tokens,
                ]
                ratios = [chars / one, bytes_ / one, entropy]
                yield pa.record_batch(
                    [part.column(n) for n, _ in fields]
                    + [pa.array(m) for m in measures]
                    + [pa.array(r, mask=~full) for r in ratios],
                    names=names,
                )

    return rows.mapInArrow(measure, schema)


def _entropy(vocabulary: _Pieces, first, lengths, offsets) -> np.ndarray:
    """Per text, the entropy of its pieces as a share of the largest it could have.

    ``first`` and ``lengths`` say where the pieces of each word of the texts are.
    """
    at = np.repeat(first - offsets_of(lengths)[:-1], lengths) + np.arange(int(lengths.sum()))
    words = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    key = np.repeat(words, lengths) * vocabulary.size + vocabulary.ids[at]
    pair, n = np.unique(key, return_counts=True)
    text = pair // vocabulary.size
    count = len(offsets) - 1
    total = np.bincount(text, n, count)
    many = np.maximum(total, 2)
    bits = np.log2(many) - np.bincount(text, n * np.log2(n), count) / many
    return np.where(total < 2, (total == 1).astype(float), bits / np.log2(np.minimum(many, ENTROPY_TOKENS)))


def base_failed():
    """The base rule on measured columns: too few words, or most of them repeated."""
    return (F.col("n_words") < 50) | (
        F.lit(100) * F.col("n_repeat_words") > F.lit(50) * F.col("n_words")
    )


def language_bands(measured: DataFrame) -> DataFrame:
    """``_lang, _low, _high, _bytes, _entropy``: the band of every language with enough documents.

    Quartiles of each measure, widened by MARGINS, over the documents that pass
    the base rule. Equal measures, as copies have, count once. Measures are
    rounded to thousandths, so that quartiles are exact and one state per
    language stays small.
    """
    rows = measured.filter(~F.col("base_failed") & F.col("token_entropy").isNotNull())
    rounded = [F.round(F.least(F.col(m), F.lit(100.0)), 3).alias(m) for m in MARGINS]
    rows = rows.select(F.col("lang").alias("_lang"), "n_tokens", *rounded).distinct()
    quartiles = [F.percentile(m, F.array(F.lit(0.25), F.lit(0.75))).alias(m) for m in MARGINS]
    found = rows.groupBy("_lang").agg(F.count(F.lit(1)).alias("_n"), *quartiles)

    def edge(name, upper):
        times, least = MARGINS[name]
        q1, q3 = F.col(name)[0], F.col(name)[1]
        room = F.greatest(times * (q3 - q1), F.lit(least))
        return q3 + room if upper else q1 - room

    return found.filter(F.col("_n") >= LEAST_DOCUMENTS).select(
        "_lang",
        edge("chars_per_token", False).alias("_low"),
        edge("chars_per_token", True).alias("_high"),
        edge("byte_share", True).alias("_bytes"),
        edge("token_entropy", False).alias("_entropy"),
    )


def in_band(bands: dict = BANDS, lang: str = "lang"):
    """Whether the measured fertility lies in the band of the row's language."""

    def inside(low, high, byte_share, entropy):
        return (
            F.col("chars_per_token").between(low, high)
            & (F.col("byte_share") <= byte_share)
            & (F.col("token_entropy") >= entropy)
        )

    verdict = inside(*bands[None])
    for name, band in bands.items():
        if name is not None:
            verdict = F.when(F.col(lang).eqNullSafe(F.lit(name)), inside(*band)).otherwise(verdict)
    return F.coalesce(verdict, F.lit(False))


def quality_rules(
    docs: DataFrame, pieces: str, bands: dict | None = None, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Measures and verdict of every document: ``base_failed`` and ``kept``.

    Returns doc_id, lang, further columns named in ``keep``, the measures, base_failed (fewer than 50 words, or
    more than half of them in repeated 3-word windows) and kept (neither
    base_failed nor outside the band of the document's language). Bands are those
    of ``language_bands`` over all documents, of BANDS for languages with few of
    them, or those given. A document without words is not kept. Equal rows and
    null ids get the same verdict; an empty table gives an empty table.
    """
    measured = fertility(docs, pieces, "lang", *keep).withColumn("base_failed", base_failed())
    if bands is not None:
        return measured.withColumn("kept", ~F.col("base_failed") & in_band(bands))
    measured = materialize(measured, "measured-texts")
    names = measured.columns
    own = materialize(language_bands(measured), "language-bands")
    judged = measured.join(F.broadcast(own), F.col("lang").eqNullSafe(F.col("_lang")), "left")
    inside = (
        F.col("chars_per_token").between(F.col("_low"), F.col("_high"))
        & (F.col("byte_share") <= F.col("_bytes"))
        & (F.col("token_entropy") >= F.col("_entropy"))
    )
    verdict = F.when(F.col("_low").isNull(), in_band()).otherwise(F.coalesce(inside, F.lit(False)))
    return judged.withColumn("kept", ~F.col("base_failed") & verdict).select(*names, "kept")
