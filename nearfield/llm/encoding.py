"""Whole-text token ids from public vocabulary files, through a bounded word cache."""

from __future__ import annotations

import re

import numpy as np

from nearfield.llm.common import kept

_CODERS: dict[str, "WordCoder"] = {}
_WORD_END = "</w>"
_ACCENTED = "ßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
_CAPITALS = "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ"
_LETTERS = re.compile(f"[a-zA-Z{_ACCENTED}{_CAPITALS}]+")
_MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def coder(path: str) -> "WordCoder":
    """The coder of a vocabulary file, kept for later tasks of this Python worker."""
    return kept(_CODERS, path, WordCoder)


class _Words(dict):
    """Ids by word; a word that is not there is asked of ``new``."""

    def __init__(self, new):
        super().__init__()
        self.new = new

    def __missing__(self, word: bytes) -> bytes:
        return self.new(word)


class WordCoder:
    """Token ids of whole texts for a vocabulary that marks word ends and drops white space.

    With such a vocabulary no token reaches over ASCII white space, so the ids
    of a text are those of its words in a row. New words of plain letters go to
    the vocabulary's model as they are met, all others of a call are encoded
    together; the cache is emptied above ``limit`` words. Other vocabularies are encoded
    text by text. Added tokens of the file are matched before the case is
    folded, so a text that may hold one in any case keeps its case, and whether
    case and trailing marks can be taken apart is asked of the vocabulary.
    """

    def __init__(self, path: str, limit: int = 500_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(_WORD_END)]] = True
        self.by_word = self.encode_text(b"a b") == self.encode_text(b"a") + self.encode_text(b"b")
        self.by_word = self.by_word and bool(self.ends.any())
        letters = b" ".join(bytes([65 + i, 97 + (i + 1) % 26, 65 + (i + 7) % 26]) for i in range(26))
        self.folds = self.encode_text(letters) == self.encode_text(letters.lower())
        self.marks_apart = all(
            self.encode_text(b"ab" + marks) == self.encode_text(b"ab") + self.encode_text(marks)
            for m in _MARKS for marks in (bytes([m]), bytes([m, m]), bytes([m]) + b".")
        )
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.added = [token.content.lower().encode() for token in added]
        self.raw = [i.to_bytes(4, "little") for i in range(len(self.ends))]
        self.limit = limit
        self.words = _Words(self._new_word)
        self.late: list[bytes] = []
        self.letters = self._model_letters()
        self.plain = all(self.letters.get(i) == chr(i) for i in range(97, 123))
        whole = not any(token.rstrip(_MARKS).decode().isalpha() for token in self.added)
        self.direct = whole and self._as_whole("abcdefghijklmnopqrstuvwxyz")
        self.accents = self.direct and self._as_whole(_ACCENTED)
        #: Runs of ASCII letters and the marks after them need no look at the rest of a word.
        self.simple = self.direct and self.folds and self.marks_apart
        self.capitals = self.accents and self.folds and self._as_whole(_CAPITALS + "ABCDEFGHIJKLMNOPQRSTUVWXYZ")

    def encode_text(self, text: bytes) -> bytes:
        """Ids as little-endian unsigned 32-bit integers, straight from the library."""
        found = self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False)
        return np.array(found.ids, "<u4").tobytes()

    def _model_letters(self) -> dict[int, str]:
        """Small letters as the model gets them, those that the normalizer leaves alone."""
        normal, pieces = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        same = lambda c: normal is None or normal.normalize_str(c) == c
        shown = lambda c: "".join(p for p, _ in pieces.pre_tokenize_str(c)) if pieces else c
        return {ord(c): shown(c) for c in map(chr, range(97, 256)) if c.islower() and same(c)}

    def _as_whole(self, letters: str) -> bool:
        """Whether runs of these letters have the same ids from the model alone."""
        if any(ord(c.lower()) not in self.letters for c in letters):
            return False
        runs = [letters, letters[::-1], *letters, *(a + b + a for a, b in zip(letters, letters[7:] + letters))]
        return all(self._encode_letters(run.lower()) == self.encode_text(run.encode()) for run in runs)

    def _encode_letters(self, stem: str) -> bytes:
        raw = self.raw
        if not (self.plain and stem.isascii()):
            stem = stem.translate(self.letters)
        return b"".join([raw[token.id] for token in self.model.tokenize(stem)])

    def _direct_form(self, stem: str) -> str | None:
        """Letters that the model may get without the rest of the library's steps, as it gets them."""
        if stem.isascii():
            return stem if self.direct and stem.islower() else None
        if not self.accents or _LETTERS.fullmatch(stem) is None:
            return None
        low = stem.lower()
        return low if self.capitals or low == stem else None

    def encode_all(self, texts: list[bytes]) -> list[bytes]:
        if not self.by_word:
            return [self.encode_text(text) for text in texts]
        if len(self.words) > self.limit:
            self.words.clear()
        ids_of, late, found, again = self.words.__getitem__, self.late, [], []
        for text in texts:
            words, before = self._folded(text).split(), len(late)
            found.append(b"".join(map(ids_of, words)))
            if len(late) > before:
                again.append((len(found) - 1, words))
        if late:
            self._learn_late()
            for i, words in again:
                found[i] = b"".join(map(ids_of, words))
        return found

    def _folded(self, text: bytes) -> bytes:
        """The text in small letters where that leaves its ids as they are."""
        if not self.folds or not text.isascii():
            return text
        low = text.lower()
        return text if any(token in low for token in self.added) else low

    def _parts(self, word: bytes) -> tuple[bytes, bytes, str]:
        """Letters and trailing marks of a word, which are separate runs to the vocabulary's splitter."""
        key = self._folded(word)
        stem = key.rstrip(_MARKS) if self.marks_apart else b""
        return stem, key[len(stem) :], stem.decode("utf-8", "replace")

    def _new_word(self, word: bytes) -> bytes:
        """Ids of a word met for the first time; what needs the whole library waits in ``late``."""
        known, stem = self.words, word.rstrip(_MARKS)
        if self.simple and stem.isalpha():
            marks, stem = word[len(stem) :], stem.lower()
            ids = known.get(stem)
            if ids is None:
                ids = known[stem] = self._encode_letters(stem.decode())
        else:
            stem, marks, run = self._parts(word)
            if not run.isalpha():
                ids = known[word] = self.encode_text(word)
                return ids
            ids = known.get(stem)
            if ids is None:
                form = self._direct_form(run)
                if form is None:
                    self.late.append(word)
                    return b""
                ids = known[stem] = self._encode_letters(form)
        if marks:
            ids += self._mark_ids(marks)
        known[word] = ids
        return ids

    def _mark_ids(self, marks: bytes) -> bytes:
        found = self.words.get(marks)
        if found is None:
            found = self.words[marks] = self.encode_text(marks)
        return found

    def _learn_late(self) -> None:
        """Words that the model may not get alone, their letters encoded together."""
        known, parts = self.words, [(word, *self._parts(word)[:2]) for word in set(self.late)]
        self.late.clear()
        self._learn_plain([stem for stem in {stem for _, stem, _ in parts} if stem not in known])
        for word, stem, marks in parts:
            known[word] = known[stem] + self._mark_ids(marks) if marks else known[stem]

    def _learn_plain(self, stems: list[bytes], chunk: int = 256) -> None:
        for at in range(0, len(stems), chunk):
            part = stems[at : at + chunk]
            ids = np.frombuffer(self.encode_text(b" ".join(part)), "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(part):
                raw, ends = ids.tobytes(), (cuts * 4).tolist()
                starts = [0, *ends[:-1]]
                self.words.update((w, raw[a:b]) for w, a, b in zip(part, starts, ends))
            else:
                self.words.update((w, self.encode_text(w)) for w in part)
