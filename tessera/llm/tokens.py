"""Word-cached encoders over public vocabularies; the path of the vocabulary file is always a parameter.

The encoders rely on the same fact: no token of these vocabularies spans ASCII white space,
so a text's ids are the ids of its words in order. A word is encoded once and remembered in a
bounded table that lives as long as the Python worker.
"""

from __future__ import annotations

import os
import re
from array import array
from collections import defaultdict
from itertools import compress, count, islice, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Entries after which a worker forgets its words: about 120 MB, unless it is told to keep fewer. An executor's workers share its memory with the JVM.
CACHE_WORDS = 600_000


#: Words in one call of the library, which bounds the memory that it needs meanwhile.
AT_ONCE = 2_000


class Words(dict):
    """word (bytes) -> its ids as little-endian uint16 bytes; unknown words are encoded on first use."""

    def __init__(self, encode, most: int = CACHE_WORDS):
        super().__init__()
        self.encode, self.most = encode, most

    def __missing__(self, word: bytes) -> bytes:
        ids = self.encode(word)
        self[word] = ids
        return ids

    def trim(self) -> None:
        if len(self) > self.most:
            self.clear()

    def ids(self, words: list[bytes]) -> bytes:
        self.trim()
        return b"".join(map(self.__getitem__, words))


def packed(ids: list[int]) -> bytes:
    return array("H", ids).tobytes()


#: Letters whose NFC form is themselves, without the one that lower-cases to two characters.
LATIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+")

#: ASCII marks that begin no pre-token together with letters, as an apostrophe may.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_MARKS = MARKS.encode()


class LowerBpe:
    """A `tokenizers` BPE file that lower-cases and drops white space, without special tokens."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.words = Words(self._word)
        # the byte-level alphabet shows bytes that are no visible character as code points from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.shown = dict(zip(sorted(set(range(256)) - set(plain)), range(256, 512)))  # noqa: B905

    def forget(self) -> None:
        self.words.clear()

    def _letters(self, piece: str) -> list:
        """A run of Latin letters is one pre-token, and no normaliser but lower-casing changes it: the model alone gives its tokens."""
        raw = piece.lower()
        if not raw.isascii():
            raw = raw.encode().decode("latin-1").translate(self.shown)
        return self.model.tokenize(raw)

    def _parts(self, word: bytes) -> tuple[list, bytes, bytes]:
        """Tokens of a word that is a letter run; or the letter run and the marks after it, which are two pre-tokens; or nothing."""
        if word.isalpha():  # ASCII letters only, as these are bytes
            return self._letters(word.decode()), b"", b""
        text = word.decode("utf-8", "replace")
        if LATIN.fullmatch(text):
            return self._letters(text), b"", b""
        head = len(text.rstrip(MARKS))
        if 0 < head < len(text) and LATIN.fullmatch(text, 0, head):
            return [], word[: head - len(text)], word[head - len(text) :]
        return [], b"", b""

    def _word(self, word: bytes) -> bytes:
        tokens, letters, marks = self._parts(word)
        if tokens:
            return packed([t.id for t in tokens])
        if letters:
            return self.words[letters] + self.words[marks]
        return packed(self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids)

    def count(self, word: bytes) -> int:
        """How many ids a word has; only parts of words are remembered."""
        tokens, letters, marks = self._parts(word)
        if tokens:
            return len(tokens)
        if letters:
            return (len(self.words[letters]) + len(self.words[marks])) // 2
        return len(self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids)

    def encode(self, text: bytes | None) -> np.ndarray:
        """All ids of a whole text. ASCII lower-casing first is safe, as the file's normaliser lower-cases anyway,
        but for two cases that are encoded in one piece: a special token's string, which is matched before
        lower-casing, and combining marks (U+0300 to U+036F), which compose before it."""
        if not text:
            return np.empty(0, "<u2")
        if whole_only(text):
            return np.asarray(self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, dtype="<u2")
        return np.frombuffer(self.words.ids(text.lower().split()), dtype="<u2")


def whole_only(text: bytes) -> bool:
    """Texts that ``LowerBpe.encode`` encodes in one piece."""
    return b"<|" in text or b"\xcc" in text or b"\xcd" in text


def _room(column: np.ndarray, n: int) -> np.ndarray:
    if n <= len(column):
        return column
    out = np.zeros(max(n, len(column) * 5 // 4), column.dtype)
    out[: len(column)] = column
    return out


def _as_list(words: pa.LargeStringArray) -> list[bytes]:
    """A whole array's strings as bytes."""
    _, places, data = words.buffers()
    raw = data.to_pybytes() if data else b""
    ends = np.frombuffer(places, np.int64, len(words) + 1).tolist() if len(words) else [0]
    return [raw[a:b] for a, b in pairwise(ends)]


class BulkLowerBpe:
    """Ids of many texts at once, the same as a LowerBpe's.

    A call's different words are found first. A word has a number in a table, and ids by that number. Words that a call meets first are encoded together: letter runs
    in one call of the library, and a letter run with marks after it is put together from the two. A full table keeps the words that
    more than one call has met since it was last full, the most frequent ones up to half its size."""

    def __init__(self, path: str):
        self.one, self.most = LowerBpe(path), CACHE_WORDS
        from tokenizers import Tokenizer, pre_tokenizers

        self.runs = Tokenizer(self.one.model)
        self.runs.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        suffix = self.one.model.end_of_word_suffix
        #: Whether an id ends a word; None where the vocabulary doesn't tell.
        self.ends = None
        if suffix:
            self.ends = np.zeros(1 << 16, bool)
            self.ends[[i for token, i in self.one.tokenizer.get_vocab(with_added_tokens=False).items() if token.endswith(suffix)]] = True
        self.shown = np.arange(256, dtype="<u2")
        for byte, point in self.one.shown.items():
            self.shown[byte] = point
        self.shown[10] = 10  # between the words
        self.forget()

    def forget(self) -> None:
        self.one.forget()
        self.table: dict[bytes, int] = defaultdict(count().__next__)
        self.known = self.stored = 0
        self.ids = np.zeros(1 << 12, "<u2")
        self.starts, self.lengths, self.met = (np.zeros(1 << 10, np.int32) for _ in range(3))

    def encode(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of these texts, one after another, and where each text's end."""
        self._trim()
        whole = {i: self.one.encode(t) for i, t in enumerate(texts) if t and whole_only(t)}
        plain = pa.array([b"" if t is None or i in whole else t for i, t in enumerate(texts)], pa.large_binary())
        split = pc.ascii_split_whitespace(pc.ascii_lower(plain.view(pa.large_string())))  # with empty words at white space at an end
        found = split.values.dictionary_encode()
        words = _as_list(found.dictionary)
        numbers = np.fromiter(map(self.table.__getitem__, words), np.int64, len(words))
        if len(self.table) > self.known:
            self._learn()
        self.met[numbers] += 1
        ids, lengths = self._gather(numbers[found.indices.to_numpy()])
        ends = np.append(0, np.cumsum(lengths))[split.offsets.to_numpy()]
        if whole:
            parts = [whole.get(i, ids[a:b]) for i, (a, b) in enumerate(pairwise(ends.tolist()))]
            return np.concatenate(parts), np.cumsum([len(p) for p in parts])
        return ids, ends[1:]

    def _gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words given by number, and how many each has."""
        lengths = self.lengths[at]
        ends = np.cumsum(lengths)
        places = np.repeat(self.starts[at] - ends + lengths, lengths)
        places += np.arange(len(places))
        return self.ids.take(places), lengths

    def _put(self, numbers: list[int] | np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        n = self.stored + len(ids)
        self.ids = _room(self.ids, n)
        self.ids[self.stored : n] = ids
        self.starts[numbers] = self.stored + np.cumsum(lengths) - lengths
        self.lengths[numbers] = lengths
        self.stored = n

    def _learn(self) -> None:
        """Encode the words that have a number but no ids yet."""
        runs, letters, marked, odd, others = [], [], [], [], []
        table, known = self.table, self.known
        while (n := len(table)) > known:  # once more for parts of words
            new = list(islice(reversed(table), n - known))
            new.reverse()
            for number, word in enumerate(new, known):
                run = word.rstrip(_MARKS)
                if run.isalpha() or not run.isascii() and LATIN.fullmatch(run.decode("utf-8", "replace")):  # isalpha: of ASCII
                    if len(run) == len(word):
                        runs.append(number)
                        letters.append(word)
                    else:
                        marked += number, table[run], table[word[len(run) :]]
                else:
                    odd.append(number)
                    others.append(word.decode("utf-8", "replace"))
            known = n
        self.known = known
        self.starts, self.lengths, self.met = (_room(c, known) for c in (self.starts, self.lengths, self.met))
        if runs:
            self._put(runs, *self._letters(letters))
        if odd:
            found = [np.array(e.ids, "<u2") for e in self.one.tokenizer.encode_batch_fast(others, add_special_tokens=False)]
            self._put(odd, np.concatenate(found), np.array([len(f) for f in found]))
        if marked:
            parts = np.array(marked).reshape(-1, 3)
            ids, lengths = self._gather(parts[:, 1:].ravel())
            self._put(parts[:, 0], ids, lengths.reshape(-1, 2).sum(axis=1))

    def _letters(self, runs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of runs of Latin letters, and how many each has."""
        if self.ends is None:
            found = [np.array([t.id for t in self.one._letters(r.decode())], "<u2") for r in runs]
            return np.concatenate(found), np.array([len(f) for f in found])
        parts = []
        for k in range(0, len(runs), AT_ONCE):
            raw = b"\n".join(runs[k : k + AT_ONCE])
            if not raw.isascii():
                raw = raw.decode().lower().encode()
            text = self.shown[np.frombuffer(raw, np.uint8)].tobytes().decode("utf-16-le")
            parts.append(np.array(self.runs.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u2"))
        ids = np.concatenate(parts)
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(runs) or ends[-1] != len(ids):
            raise ValueError(f"{len(runs)} words were encoded as {len(ends)}")
        return ids, np.diff(ends, prepend=0)

    def _trim(self) -> None:
        if self.known <= self.most:
            return
        met = self.met[: self.known]
        kept = np.argsort(-met, kind="stable")[: self.most // 2]
        kept = np.sort(kept[met[kept] > 1])
        ids, lengths = self._gather(kept)
        stays = np.zeros(self.known, bool)
        stays[kept] = True
        words = list(compress(self.table, stays.tolist()))
        self.forget()
        self.table = defaultdict(count(len(words)).__next__, zip(words, range(len(words)), strict=True))
        self.known = len(words)
        self.starts, self.lengths, self.met = (_room(c, self.known) for c in (self.starts, self.lengths, self.met))
        self._put(np.arange(self.known), ids, lengths)
        self.met[: self.known] = 1


class PieceBpe:
    """A `sentencepiece` file with byte fallback; ids of each white-space word by itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.model.get_piece_size()
        self.bytes = np.array([self.model.is_byte(i) for i in range(size)])

    def encode(self, word: bytes) -> list[int]:
        return self.model.encode(word.decode("utf-8", "replace"))


_LOADED: dict[tuple, object] = {}


def loaded(kind: type, path: str | tuple):
    """The encoder of a Python worker, which is used again by its next tasks; one at a time."""
    key = (kind, path)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = kind(path)
    return _LOADED[key]


def release() -> None:
    """Give the words of a worker's encoder back, so that later stages in the same worker have the memory."""
    for encoder in _LOADED.values():
        encoder.forget()


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
