"""Token ids of whole texts through the ``tokenizers`` library, with a bounded cache of word encodings.

A text is cut only where the tokenizer's own pre-tokenizer always cuts, so the ids equal those of the uncut text. Pieces
that a Python worker has seen lately are looked up; the others go to the tokenizer: plain words of Latin letters in one
joined string, whose ids are dealt back to the words by the tokens' lengths in bytes, all else piece by piece.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Cached pieces per Python worker, and the longest piece that is kept.
CACHE_PIECES = 1_000_000
CACHE_CHARS = 64
#: The id that ends a document in the files and sequences.
DOCUMENT_END = 2
#: Pieces that the tokenizer gets at once.
STORE_PIECES = 20_000


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


class _Slots(dict):
    """Piece -> slot; an unknown piece gets the next slot and is noted in ``new``."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []
        self.next = 0

    def __missing__(self, piece: str) -> int:
        slot = self[piece] = self.next
        self.next += 1
        self.new.append(piece)
        return slot


#: A word of Latin letters, which no pre-tokenizer known here cuts, and ASCII punctuation after it, a token run of its own.
_WORD = re.compile(r" ?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+")
_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


class Encoder:
    """``ids(texts)`` gives the ids of all texts in one flat array and the count of each text.

    ``most`` pieces stay cached between calls; beyond, the half that fewest calls used lately is forgotten.
    """

    def __init__(self, path: str, most: int | None = None) -> None:
        self.most = CACHE_PIECES if most is None else most
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        # the parts' own settings: the whole file, with its vocabulary, would take far more memory as Python objects
        parts = {name: getattr(self.tokenizer, name) for name in ("pre_tokenizer", "normalizer")}
        spec = {name: json.loads(part.__getstate__()) if part is not None else None for name, part in parts.items()}
        self.cut = _cutter(spec)
        self.words = None if self.cut is _cut_whole else _Words(self.tokenizer, spec)
        self._clear()

    def _clear(self) -> None:
        self.slots = _Slots()
        self.flat = np.zeros(1 << 16, np.uint32)
        self.starts = np.zeros(1 << 12, np.int64)
        self.counts = np.zeros(1 << 12, np.int32)
        self.calls = np.zeros(1 << 12, np.int32)  # that used a slot
        self.used = 0

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of every text, in order, without special tokens; the empty text has none."""
        slots, per_text = self._slots_of(texts)
        new, self.slots.new = self.slots.new, []
        self._store(new)
        self.calls[slots] += 1
        ids, ends = self._gather(slots)
        bounds = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(per_text)))]
        for piece in new:
            if len(piece) > CACHE_CHARS:
                del self.slots[piece]
        if self.slots.next > self.most or self.used > 16 * self.most:
            self._shrink()
        return ids, np.diff(bounds)

    def _slots_of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The slots of all pieces in a row, and how many each text has. Texts that are cut at every blank and line feed are cut together, and only their distinct pieces are looked up."""
        even = np.fromiter(map(_cut_at_blanks, texts), bool, len(texts)) if self.cut is _cut_byte_level else np.zeros(len(texts), bool)
        pieces: list[str] = []
        per_text = np.zeros(len(texts), np.int64)
        for i in np.flatnonzero(~even).tolist():
            cut = self.cut(texts[i])
            per_text[i] = len(cut)
            pieces += cut
        odd = np.fromiter(map(self.slots.__getitem__, pieces), np.int64, len(pieces))
        del pieces
        if not even.any():
            return odd, per_text
        column = pa.array([text for text, e in zip(texts, even.tolist()) if e], pa.large_string())
        column = pc.replace_substring(pc.replace_substring(column, " ", "\0 "), "\n", "\0\n\0")
        lists = pc.split_pattern(column, "\0")
        found = lists.flatten().dictionary_encode()
        distinct = np.fromiter(map(self.slots.__getitem__, found.dictionary.to_pylist()), np.int64, len(found.dictionary))
        slots = distinct[found.indices.to_numpy()]
        per_text[even] = np.diff(lists.offsets.to_numpy())
        if even.all():
            return slots, per_text
        out = np.zeros(len(slots) + len(odd), np.int64)
        of_even = np.repeat(even, per_text)
        out[of_even], out[~of_even] = slots, odd
        return out, per_text

    def _gather(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces in a row, and where each piece's end."""
        counts = self.counts[slots]
        ends = np.cumsum(counts, dtype=np.int64)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.starts[slots] - (ends - counts), counts) + np.arange(total)], ends

    def _store(self, new: list[str]) -> None:
        """Encode the pieces that have slots but no ids yet."""
        alone, words, marks, both, rest = [], [], [], [], []
        for piece in new:
            word = piece.rstrip(_PUNCTUATION)
            if self.words is None or len(piece) > CACHE_CHARS or not _WORD.fullmatch(word):
                rest.append(piece)
            elif len(word) == len(piece):
                alone.append(piece)
            else:
                words.append(word)
                marks.append(piece[len(word) :])
                both.append(piece)
        # words and marks that have not come alone yet get slots of their own, as they will come with others
        parts = [np.fromiter(map(self.slots.__getitem__, words), np.int64, len(words))]
        alone, self.slots.new = alone + self.slots.new, []
        parts.append(np.fromiter(map(self.slots.__getitem__, marks), np.int64, len(marks)))
        rest, self.slots.new = rest + self.slots.new, []
        for at in range(0, len(alone), STORE_PIECES):
            part = alone[at : at + STORE_PIECES]
            self._put(part, *(self.words.ids(part) or self._plain(part)))
        for at in range(0, len(rest), STORE_PIECES):
            part = rest[at : at + STORE_PIECES]
            self._put(part, *self._plain(part))
        if both:
            ids, ends = self._gather(np.column_stack(parts).ravel())
            self._put(both, ids, np.diff(ends[1::2], prepend=0))

    def _plain(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for ids in found for i in ids), np.uint32, int(counts.sum())), counts

    def _put(self, pieces: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        slots = np.fromiter(map(self.slots.__getitem__, pieces), np.int64, len(pieces))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        while self.slots.next > len(self.starts):
            self.starts, self.counts, self.calls = (np.concatenate((x, np.zeros_like(x))) for x in (self.starts, self.counts, self.calls))
        self.flat[self.used : self.used + len(ids)] = ids
        self.starts[slots] = self.used + np.cumsum(counts) - counts
        self.counts[slots] = counts
        self.used += len(ids)

    def _shrink(self) -> None:
        """Forget all but the half of ``most`` pieces that most calls used lately; of equals, the newest stay."""
        names = list(self.slots)
        slots = np.fromiter(self.slots.values(), np.int64, len(names))
        calls = self.calls[slots]
        order = np.lexsort((slots, calls))[max(0, len(names) - self.most // 2) :]
        order.sort()
        ids, ends = self._gather(slots[order])
        self._clear()
        names = [names[i] for i in order.tolist()]
        for name in names:
            self.slots[name]
        self.slots.new = []
        self._put(names, ids, np.diff(ends, prepend=0))
        self.calls[: len(names)] = calls[order] // 2


class _Words:
    """Ids of plain words through a tokenizer around the same model that takes them joined, in the model's own alphabet of bytes."""

    def __init__(self, tokenizer, spec: dict) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer(tokenizer.model)
        self.tokenizer.pre_tokenizer = pre_tokenizers.Split("\n", "removed")
        self.lower = spec.get("normalizer") is not None
        ending = getattr(tokenizer.model, "end_of_word_suffix", None) or ""
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.lengths = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, number in vocabulary.items():
            self.lengths[number] = len(token.removesuffix(ending))
        # the alphabet: visible Latin-1 characters stand for themselves, the other bytes for the characters from 256 on
        self.alphabet = np.arange(256, dtype="<u4")
        others = [b for b in range(256) if not (33 <= b < 127 or 161 <= b < 173 or b >= 174)]
        self.alphabet[others] = 256 + np.arange(len(others))
        self.alphabet[10] = 10

    def ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of all words in a row and the count of each; None if the tokens' lengths do not add up to the words'."""
        line = "\n".join(words)
        data = np.frombuffer((line.lower() if self.lower else line).encode(), np.uint8)
        line = self.alphabet[data].tobytes().decode("utf-32-le")
        ids = np.array(self.tokenizer.encode_batch_fast([line], add_special_tokens=False)[0].ids, np.uint32)
        edges = np.append(np.flatnonzero(data == 10), len(data)) - np.arange(len(words))
        ends = np.cumsum(self.lengths[ids])
        at = np.searchsorted(ends, edges)
        if not len(ids) or ends[-1] != edges[-1] or not np.array_equal(ends[at], edges):
            return None
        return ids, np.diff(at + 1, prepend=0)


#: White space other than the ASCII kinds, and what some count as such; also NUL, which marks the cuts.
_OTHER_SPACES = "\0\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_RUNS = ("  ", " \n", "\n ", "\n\n", "\t", "\r", "\v", "\f")
#: With runs of ASCII white space: all of a run but its last character is a piece, and a last blank belongs to the word after it.
_WITH_RUNS = re.compile(r" ?[^ \t\n\r\v\f]+|[ \t\n\r\v\f]+(?![^ \t\n\r\v\f])|[ \t\n\r\v\f]")


def _has_other_spaces(text: str) -> bool:
    return any(c in text for c in (_OTHER_SPACES[:5] if text.isascii() else _OTHER_SPACES))


def _has_runs(text: str) -> bool:
    return text[0] in " \n" or text[-1] in " \n" or any(run in text for run in _RUNS)


def _cut_at_blanks(text: str) -> bool:
    """Whether a byte-level tokenizer's text is cut at all its blanks and line feeds, of which no two follow each other, and nowhere else."""
    return bool(text) and not _has_other_spaces(text) and not _has_runs(text)


def _cut_byte_level(text: str) -> list[str]:
    # a blank belongs to the word after it; a line feed between two words is a piece of its own
    if not text:
        return []
    if _has_other_spaces(text):
        return [text]
    if _has_runs(text):
        return _WITH_RUNS.findall(text)
    return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")


def _cut_words(text: str) -> list[str]:
    # White space is dropped; others than blank and line feed stay inside the pieces, for the tokenizer. It
    # lower-cases anyway; doing so before saves pieces, and is the same character by character up to U+00FF.
    try:
        text.encode("latin-1")
        text = text.lower()
    except UnicodeEncodeError:
        pass
    pieces = text.replace("\n", " ").split(" ")
    return [piece for piece in pieces if piece] if "" in pieces else pieces


def _cut_whole(text: str) -> list[str]:
    return [text] if text else []


def _cutter(spec: dict):
    """The cut that is safe for a tokenizer file."""
    pre, normalizer = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and normalizer is None:
        return _cut_byte_level
    first = (pre.get("pretokenizers") or [{}])[0]
    drops_blanks = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") and r"[^\s" in str((first.get("pattern") or {}).get("Regex"))
    known = {"NFC", "Replace", "Lowercase"} >= {n["type"] for n in (normalizer or {}).get("normalizers", [])}
    return _cut_words if drops_blanks and known else _cut_whole


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str, most: int | None = None) -> Encoder:
    """One encoder a Python process and path; ``most``: pieces that it caches from now on."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path, most)
    _ENCODERS[path].most = CACHE_PIECES if most is None else most
    return _ENCODERS[path]


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Append ``end_id`` to the ids of every text."""
    ends = np.cumsum(counts)
    return np.insert(ids, ends, end_id).astype(np.uint32), counts + 1


def pieces_of(ids: np.ndarray, counts: np.ndarray) -> Iterator[np.ndarray]:
    ends = np.cumsum(counts)
    for a, b in zip(ends - counts, ends):
        yield ids[a:b]
