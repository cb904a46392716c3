"""Token ids of whole texts through the tokenizers library, word by word with a bounded cache."""

from __future__ import annotations

import ctypes
import gc
import os
import re
from collections.abc import Callable, Iterator
from functools import wraps
from itertools import chain
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A cut before a single space between two non-space characters never falls inside a
#: token of a byte-level tokenizer: no pattern of its splitter looks across it.
_CUT = re.compile(r"(?<=\S) (?=\S)")
_OTHER_SPACE = r"\t\r\f\v\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Texts whose white space is more than single spaces and line feeds apart from each other.
_ODD_SPACE = rf"  | \n|\n |\A | \z|[{_OTHER_SPACE}]"
#: Pieces whose tokens hold just their bytes: one space before them and none at their ends ...
_KEPT_BYTES = rf"(?s)\A[^ \n{_OTHER_SPACE}](?:.*[^ \n{_OTHER_SPACE}])?\z"
#: ... or, without white space, of characters that no normal form and no lower case changes in length.
_PLAIN_BYTES = r"\A[!-~\x{a1}-\x{12f}\x{131}-\x{17f}]+\z"
#: Letters and then marks: every splitter cuts between the two, and keeps each whole.
_LETTERS = r"\A(?P<stem>\p{L}+)(?P<tail>[!-&(-/:-@\[-`{-~]*)\z"
#: The same of characters that no normal form and no lower case changes in length.
_PLAIN_LETTERS = _LETTERS.replace(r"\p{L}", r"[A-Za-z\x{aa}\x{b5}\x{ba}\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{12f}\x{131}-\x{17f}]")
_JOINED = 256
_NOTHING = 0
_ID = attrgetter("id")
#: Bytes of text that a task encodes at a time, a longer text alone.
TEXT_AT_ONCE = 1 << 21
_END_OF_WORD = "</w>"


def _spelling() -> dict[int, int]:
    """Byte-level spelling: printable bytes of Latin-1 stand for themselves, others for the code points from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(others)}


_SPELLED = _spelling()
#: Words are spelled many at a time, one on a line.
_SPELLED_LINES = _SPELLED | {0x0A: 0x0A}


def _strings(x: pa.Array) -> list[str]:
    return x.to_numpy(zero_copy_only=False).tolist()


def _gathered(ids: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Runs of ids, one after the other."""
    ends = np.cumsum(length)
    return ids[np.repeat(start - (ends - length), length) + np.arange(int(ends[-1]) if len(ends) else 0)]


class WordEncoder:
    """Ids of whole texts, equal to ``Tokenizer.encode(text, add_special_tokens=False)``.

    A text is cut where no token can cross, each distinct piece is encoded
    once by the library, and the ids of a text are the ids of its pieces in
    order. Cutting and finding the distinct pieces are Arrow kernels. Of a piece
    of letters and marks behind them the two are encoded and kept, not the whole.
    ``spaces_kept`` says whether the tokenizer gives a space to the word behind
    it (byte level) or drops white space. The cache starts anew when it holds
    ``cache_words`` pieces, so its memory is bounded.
    """

    def __init__(self, path: str, spaces_kept: bool, cache_words: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._spaces_kept = spaces_kept
        self._limit = cache_words
        added = self._tokenizer.get_added_tokens_decoder()
        special = [(i, t) for i, t in added.items() if t.special]
        self._mark = min(special, key=lambda x: x[0])[0] if special else None
        self._marker = self._tokenizer.id_to_token(self._mark) if special else None
        self._added = [t.content for t in added.values()]
        # A byte-level vocabulary spells each byte as one character.
        self._bytes = np.zeros(self.n_ids, np.int64)
        for token, i in self._tokenizer.get_vocab(with_added_tokens=False).items():
            self._bytes[i] = len(token.removesuffix(_END_OF_WORD))
        self._model = self._tokenizer.model
        words = ["word", "Straße", "ÉTÉ", "naïveté", "x"]
        self._reset()
        # Whether words of letters can go to the library's model without its splitter.
        try:
            own = [self._tokens(w) for w in self._spelled(words)]
        except Exception:  # noqa: BLE001 - a model of another kind knows no such words
            own = []
        whole = self._tokenizer.encode_batch_fast([self._as_text(w) for w in words], add_special_tokens=False)
        self._by_letters = own == [e.ids for e in whole]

    @property
    def n_ids(self) -> int:
        """The number of ids, added tokens included."""
        return self._tokenizer.get_vocab_size(with_added_tokens=True)

    def _reset(self) -> None:
        self._codes: dict[str, int] = {}
        # Number _NOTHING has no name and no ids.
        self._n_codes = 1
        self._ids = np.zeros(1 << 16, np.uint32)
        self._n_ids = 0
        self._start = np.zeros(1 << 14, np.int64)
        self._length = np.zeros(1 << 14, np.int64)

    def _as_text(self, piece: str) -> str:
        """A piece as the library must see it; the first one of a space-keeping tokenizer is marked by a space."""
        if not self._spaces_kept:
            return piece
        return piece[1:] if piece[:1] == " " else " " + piece

    def _spelled(self, words: list[str]) -> list[str]:
        """Words of letters as the model sees them behind the library's splitter."""
        lines = "\n".join(words)
        lines = (lines if self._spaces_kept else lines.lower()).encode().decode("latin-1").translate(_SPELLED_LINES)
        lead = chr(_SPELLED[0x20]) if self._spaces_kept else ""
        return [lead + w for w in lines.split("\n")]

    def _tokens(self, spelled: str) -> list[int]:
        return [t.id for t in self._model.tokenize(spelled)]

    def _has_added(self, pieces: pa.Array) -> np.ndarray:
        """Which pieces may hold an added token; all of them where no special token can stand between pieces."""
        found = np.full(len(pieces), self._marker is None)
        for a in self._added:
            found |= pc.match_substring(pieces, a).to_numpy(zero_copy_only=False)
        return found

    def _encode_new(self, pieces: list[str]) -> None:
        """Encode unseen pieces, many to a call."""
        known = pa.array(pieces, pa.large_string())
        alone = self._has_added(known)
        pattern = _KEPT_BYTES if self._spaces_kept else _PLAIN_BYTES
        plain = ~alone & pc.match_substring_regex(known, pattern).to_numpy(zero_copy_only=False)
        sizes = pc.binary_length(known).to_numpy() + (1 if self._spaces_kept else 0)
        self._encode_by_bytes([pieces[i] for i in np.flatnonzero(plain)], sizes[plain])
        self._encode_by_marks([pieces[i] for i in np.flatnonzero(~alone & ~plain)])
        single = [pieces[i] for i in np.flatnonzero(alone)]
        for piece, encoded in zip(single, self._ids_of([self._as_text(p) for p in single]), strict=True):
            self._store([piece], encoded, np.array([0]), np.array([len(encoded)]))

    def _encode_stems(self, stems: list[str]) -> None:
        """Encode unseen words of letters by the model."""
        tokens = list(map(self._model.tokenize, self._spelled(stems)))
        lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        flat = np.fromiter(map(_ID, chain.from_iterable(tokens)), np.uint32, int(lengths.sum()))
        self._store(stems, flat, np.cumsum(lengths) - lengths, lengths)

    def _units_of(self, pieces: pa.Array) -> np.ndarray:
        """Two numbers for each distinct piece: its letters and the marks behind them, or the whole piece and nothing."""
        units = np.full((len(pieces), 2), _NOTHING)
        whole = np.ones(len(pieces), bool)
        if self._by_letters:
            found = pc.extract_regex(pieces, _LETTERS if self._spaces_kept else _PLAIN_LETTERS)
            whole = found.is_null().to_numpy(zero_copy_only=False) | self._has_added(pieces)
        if whole.any():
            units[whole, 0] = self._codes_of(_strings(pieces.filter(pa.array(whole))), self._encode_new)
        if not whole.all():
            letters = pa.array(~whole)
            stems, tails = (found.field(x).filter(letters).dictionary_encode() for x in ("stem", "tail"))
            units[~whole, 0] = self._codes_of(_strings(stems.dictionary), self._encode_stems)[stems.indices.to_numpy()]
            # What follows a word has no space before it: for a space-keeping tokenizer the form of a first piece.
            lead = " " if self._spaces_kept else ""
            marks = _strings(tails.dictionary)
            ends = np.full(len(marks), _NOTHING)
            some = [i for i, t in enumerate(marks) if t]
            ends[some] = self._codes_of([lead + marks[i] for i in some], self._encode_by_marks)
            units[~whole, 1] = ends[tails.indices.to_numpy()]
        return units

    def _ids_of(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_by_bytes(self, pieces: list[str], sizes: np.ndarray) -> None:
        """Join pieces by single spaces and tell their tokens apart by the bytes that they hold."""
        if not pieces:
            return
        lead = " " if self._spaces_kept else ""
        groups = [lead + " ".join(pieces[i : i + _JOINED]) for i in range(0, len(pieces), _JOINED)]
        ids = np.concatenate(self._ids_of(groups))
        held = self._bytes[ids]
        ends = np.cumsum(held)
        last = np.searchsorted(ends, np.cumsum(sizes))
        if len(ids) == 0 or held.min() == 0 or last[-1] != len(ids) - 1 or (ends[last] != np.cumsum(sizes)).any():
            # Tokens of this vocabulary do not hold just the bytes of a piece.
            self._encode_by_marks(pieces)
            return
        begins = np.concatenate(([0], last[:-1] + 1))
        self._store(pieces, ids, begins, last + 1 - begins)

    def _encode_by_marks(self, pieces: list[str]) -> None:
        """Join pieces by a special token of the library."""
        groups = [pieces[i : i + _JOINED] for i in range(0, len(pieces), _JOINED)]
        for group, ids in zip(groups, self._ids_of([self._marker.join(map(self._as_text, g)) for g in groups]), strict=True):
            marks = np.flatnonzero(ids == self._mark)
            begins = np.concatenate(([0], marks + 1))
            ends = np.concatenate((marks, [len(ids)]))
            self._store(group, ids, begins, ends - begins)

    def _store(self, pieces: list[str], ids: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> None:
        # A piece may be stored twice, so numbers do not follow from the size of the cache.
        first = self._n_codes
        self._n_codes += len(pieces)
        while self._n_ids + len(ids) > len(self._ids):
            self._ids = np.concatenate((self._ids, np.zeros_like(self._ids)))
        while first + len(pieces) > len(self._start):
            self._start = np.concatenate((self._start, np.zeros_like(self._start)))
            self._length = np.concatenate((self._length, np.zeros_like(self._length)))
        self._ids[self._n_ids : self._n_ids + len(ids)] = ids
        self._start[first : first + len(pieces)] = begins + self._n_ids
        self._length[first : first + len(pieces)] = lengths
        self._n_ids += len(ids)
        self._codes.update(zip(pieces, range(first, first + len(pieces)), strict=True))

    def _codes_of(self, pieces: list[str], encode: Callable[[list[str]], None]) -> np.ndarray:
        """Numbers of distinct pieces in the cache; ``encode`` stores unseen ones."""
        codes = self._codes
        new = [p for p in pieces if p not in codes]
        if new:
            encode(new)
        return np.fromiter(map(codes.__getitem__, pieces), np.int64, len(pieces))

    def _cut_plainly(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(units of distinct pieces, pieces by number, pieces of each text) of texts that are cut at every space."""
        lists = pc.split_pattern(texts, " ")
        words = lists.flatten().dictionary_encode()
        which = words.indices.to_numpy()
        offsets = lists.offsets.to_numpy()
        units = self._units_of(words.dictionary)
        if self._spaces_kept:
            begins = offsets[:-1] - offsets[0]
            firsts, back = np.unique(which[begins], return_inverse=True)
            spelled = [" " + w for w in _strings(words.dictionary.take(pa.array(firsts)))]
            which = which.astype(np.int64)
            which[begins] = len(units) + back
            own = np.full((len(firsts), 2), _NOTHING)
            own[:, 0] = self._codes_of(spelled, self._encode_new)
            units = np.concatenate((units, own))
        return units, which, np.diff(offsets)

    def _cut_oddly(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for texts of a space-keeping tokenizer with other white space."""
        pieces: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            own = _CUT.split(text)
            own[0] = " " + own[0]
            counts[i] = len(own)
            pieces += own
        places = {p: i for i, p in enumerate(dict.fromkeys(pieces))}
        which = np.fromiter(map(places.__getitem__, pieces), np.int64, len(pieces))
        return self._units_of(pa.array(list(places), pa.large_string())), which, counts

    def encode(self, texts: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids one text after the other, number of ids of each text); null texts have none."""
        if len(self._codes) > self._limit:
            self._reset()
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.large_string())
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        full = pc.binary_length(texts).to_numpy() > 0
        odd = np.zeros(len(texts), bool)
        if self._spaces_kept:
            odd = full & pc.match_substring_regex(texts, _ODD_SPACE).to_numpy(zero_copy_only=False)
        plain = full & ~odd
        counts = np.zeros(len(texts), np.int64)
        units, cut = np.zeros((0, 2), np.int64), []
        for mine, how in ((plain, self._cut_plainly), (odd, self._cut_oddly)):
            if mine.any():
                chosen = texts.filter(pa.array(mine))
                own, which, counts[mine] = how(chosen if how == self._cut_plainly else chosen.to_pylist())
                cut.append((mine, which + len(units)))
                units = np.concatenate((units, own))
        which = np.empty(int(counts.sum()), np.int64)
        for mine, pieces in cut:
            which[np.repeat(mine, counts)] = pieces
        # The ids of the distinct pieces of these texts, then those of the texts.
        lengths = self._length[units].sum(axis=1)
        ids = _gathered(self._ids, self._start[units.ravel()], self._length[units.ravel()])
        bounds = np.concatenate(([0], np.cumsum(lengths[which])))
        upto = bounds[np.concatenate(([0], np.cumsum(counts)))]
        return _gathered(ids, (np.cumsum(lengths) - lengths)[which], lengths[which]), np.diff(upto)


_ENCODERS: dict[tuple[str, bool], WordEncoder] = {}


def encoder_of(path: str, spaces_kept: bool) -> WordEncoder:
    """The encoder of this worker process."""
    key = (path, spaces_kept)
    if key not in _ENCODERS:
        # Another operator's tasks may have left memory free but held, and loading leaves some of its own.
        give_back_memory()
        _ENCODERS[key] = WordEncoder(path, spaces_kept)
        give_back_memory()
    return _ENCODERS[key]


def free_encoders() -> None:
    """Drop the encoders of this worker process, which Spark may have kept from another operator's tasks."""
    if _ENCODERS:
        _ENCODERS.clear()
        give_back_memory()


def giving_back(work: Callable) -> Callable:
    """A task's function over batches that returns freed memory to the system at its end.

    Spark keeps idle worker processes for later tasks, also of other operators,
    and what they hold but do not use counts against those.
    """

    @wraps(work)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        give_back_memory(cycles=False)

    return run


def give_back_memory(cycles: bool = True) -> None:
    """Return what this worker process has freed to the system, as far as it can; ``cycles`` are collected first."""
    if cycles:
        gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        # Not every C library can give memory back.
        pass
