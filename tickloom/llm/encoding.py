"""Token ids of whole texts from the tokenizers library, with a cache of words.

No token of the two vocabularies crosses from a non-space character to a following ASCII space,
tab or line break, so that a text's ids are those of its pieces ``spaces + word`` one after the
other. The distinct pieces of a group of texts are told apart by Arrow, and each is encoded by the
library once per worker. Pieces of plain letters and signs are made of the library's ids of either,
as its own splitting does; texts that hold a special token's opening ``<|`` or other white space,
where that argument fails, go to the library whole.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tickloom.llm.common import give_back

PIECES = re.compile(r"[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+")
#: What a text that goes to the library whole holds: an opening of special tokens, or white space of other kinds.
ODD_WORDS = ["<|", *map(chr, range(0x1C, 0x20))]
ODD_PIECES = [*ODD_WORDS, "\0", *map(chr, (0x0B, 0x0C, 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF))]

#: Latin letters, then signs but the apostrophe: the library's splitting cuts between the two and nowhere else.
WORD_AND_SIGNS = re.compile(r"(\0?)([A-Za-zÀ-ÖØ-öø-ɏ]*)([!-&(-/:-@\[-`{-~]*)")
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
#: The characters that stand for bytes in byte-level vocabularies.
BYTE_CHARS = {b: chr(b) for b in _SHOWN} | {b: chr(0x100 + k) for k, b in enumerate(sorted({*range(0x100)} - {*_SHOWN}))}


def spaced(text: str) -> bool:
    """Whether the pieces of a text are more than what lies between its spaces."""
    return "  " in text or "\n " in text or "\t " in text or "\r " in text or text.endswith(" ")


def split_pieces(text: str) -> list[str]:
    """Pieces of a text: those that follow a single space go without it, others after a NUL."""
    if spaced(text):
        return ["\0" + p for p in PIECES.findall(text)]
    split = text.split(" ")
    if split[0]:
        split[0] = "\0" + split[0]
        return split
    return split[1:]


def tokenizer_digest(path: str) -> str:
    """Names a tokenizer version: its file's content and the library's release."""
    import tokenizers

    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + tokenizers.__version__.encode()).hexdigest()


class _Index(dict):
    """The ids of pieces, as bytes; asks for pieces it doesn't have are noted."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, piece: str) -> None:
        self.new.append(piece)


class Encoder:
    """``cache_pieces`` and ``cache_chars`` bound the worker's cache, which starts anew beyond them."""

    def __init__(self, path: str, spaces_matter: bool, cache_pieces: int = 500_000, cache_chars: int = 8 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.split = split_pieces if spaces_matter else str.split
        self.odd = ODD_PIECES if spaces_matter else ODD_WORDS
        self.limits = cache_pieces, cache_chars
        size = self.library.get_vocab_size(with_added_tokens=True)
        self.bytes_of = np.array([len(self.library.id_to_token(i) or "") for i in range(size)], np.int64) if spaces_matter else None
        self.kind = np.dtype(np.uint16 if size <= 1 << 16 else np.uint32)
        self._clear()

    def _clear(self) -> None:
        self.index = _Index()
        self.chars = 0

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _each(self, part: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of several pieces one after the other, and how many each has."""
        if self.bytes_of is None:
            got = self.library.encode(part, is_pretokenized=True, add_special_tokens=False)
            return np.array(got.ids, np.uint32), np.bincount(np.array(got.word_ids, np.int64), minlength=len(part))
        ids = np.array(self._library(["".join(part)])[0], np.uint32)
        ends = np.cumsum([len(p.encode()) for p in part])
        return ids, np.diff(np.searchsorted(np.cumsum(self.bytes_of[ids]), ends, side="right"), prepend=0)

    def _unit(self, key: str, word: str) -> bytes:
        """The ids of letters only or signs only, which the library's splitting leaves whole; ``key`` is not known yet."""
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(BYTE_CHARS)
        found = self.model.tokenize(word if key[0] == "\0" else BYTE_CHARS[0x20] + word)
        raw = self.index[key] = array(self.kind.char, [t.id for t in found]).tobytes()
        self.chars += len(key)
        return raw

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        """The ids of pieces that are not known; those of letters and signs together are made again when they are met again."""
        made: dict[str, bytes] = {}
        keys, parts = ([], []) if self.bytes_of is not None else (new, new)
        known, unit, shape_of = self.index.get, self._unit, WORD_AND_SIGNS.fullmatch
        for key in new if self.bytes_of is not None else ():
            if shape := shape_of(key):
                start, word, signs = shape.groups()
                if word and signs:
                    first, last = start + word, "\0" + signs
                    made[key] = (known(first) or unit(first, word)) + (known(last) or unit(last, signs))
                else:  # it may have been met as a part of another meanwhile
                    made[key] = known(key) or unit(key, word or signs)
                continue
            piece = key[1:] if key[0] == "\0" else " " + key
            # pieces that don't start with white space, or end with it, can't be told apart once joined
            if piece[0] <= " " < piece[-1]:
                keys.append(key)
                parts.append(piece)
            else:
                self.index[key] = made[key] = np.array(self._library([piece])[0], self.kind).tobytes()
                self.chars += len(key)
        for k in range(0, len(keys), 512):
            ids, n = self._each(parts[k : k + 512])
            raw, size = ids.astype(self.kind).tobytes(), self.kind.itemsize
            ends = (np.cumsum(n) * size).tolist()
            found = dict(zip(keys[k : k + 512], (raw[a:b] for a, b in zip([0, *ends], ends, strict=False)), strict=True))
            self.index.update(found)
            made.update(found)
        self.chars += sum(map(len, keys))
        return made

    def _groups(self, texts: Iterable[str], chars: int = 2 << 20) -> Iterator[list[str]]:
        """The texts in groups, of which the new pieces are encoded together."""
        group, n = [], 0
        for text in texts:
            group.append(text)
            n += len(text)
            if n > chars:
                yield group
                group, n = [], 0
        if group:
            yield group

    def _look_up(self, group: list[str]) -> tuple[list[bytes], np.ndarray, list[tuple[int, int]], dict[int, bytes]]:
        """The ids of the distinct pieces, all pieces by their number among these, each text's bounds in them, and the ids of texts that went whole."""
        plain, listed, whole, order = [], [], {}, ([], [])
        for i, text in enumerate(group):
            if any(c in text for c in self.odd):
                whole[i] = np.array(self._library([text])[0], self.kind).tobytes()
            elif self.bytes_of is not None and text and not spaced(text):
                plain.append(text[1:] if text[0] == " " else "\0" + text)
                order[0].append(i)
            else:
                listed.append(self.split(text))
                order[1].append(i)
        split = pc.split_pattern(pa.array(plain, pa.large_string()), " ")
        keys = pa.concat_arrays([split.flatten(), pa.array(list(chain.from_iterable(listed)), pa.large_string())]).dictionary_encode()
        ends = np.cumsum(np.concatenate([np.diff(split.offsets.to_numpy()), np.array([len(x) for x in listed], np.int64)])).tolist()
        bounds = [(0, 0)] * len(group)
        for i, of in zip(chain(*order), zip([0, *ends], ends, strict=False), strict=True):
            bounds[i] = of
        if len(self.index) > self.limits[0] or self.chars > self.limits[1]:
            self._clear()
        distinct, find, new = keys.dictionary.to_numpy(zero_copy_only=False).tolist(), self.index.__getitem__, self.index.new
        found = list(map(find, distinct))
        if new:
            made = self._learn(new)
            new.clear()
            found = [made[p] if raw is None else raw for raw, p in zip(found, distinct, strict=True)]
        return found, keys.indices.to_numpy(), bounds, whole

    def ids(self, texts: Iterable[str], at_once: int = 1 << 17) -> Iterator[np.ndarray]:
        """The ids of each text."""
        for group in self._groups(texts):
            found, pieces, bounds, whole = self._look_up(group)
            raw = np.frombuffer(b"".join(found), self.kind)
            sizes = np.array([len(x) for x in found], np.int64) // self.kind.itemsize
            shift = np.cumsum(sizes) - sizes
            parts = [np.empty(0, self.kind)]
            for k in range(0, len(pieces), at_once):
                own = pieces[k : k + at_once]
                n = sizes[own]
                parts.append(raw[np.repeat(shift[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())])
            joined, ends = np.concatenate(parts), np.concatenate([[0], np.cumsum(sizes[pieces])]).astype(np.int64)
            for i, (a, b) in enumerate(bounds):
                yield np.frombuffer(whole[i], self.kind) if i in whole else joined[ends[a] : ends[b]]

    def counts(self, texts: Iterable[str]) -> Iterator[int]:
        """The number of ids of each text."""
        for group in self._groups(texts):
            found, pieces, bounds, whole = self._look_up(group)
            sizes = np.array([len(x) for x in found], np.int64)
            ends = np.concatenate([[0], np.cumsum(sizes[pieces])]).astype(np.int64)
            for i, (a, b) in enumerate(bounds):
                yield (len(whole[i]) if i in whole else int(ends[b] - ends[a])) // self.kind.itemsize


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, spaces_matter: bool) -> Encoder:
    """One encoder for each worker process and tokenizer."""
    if (path, spaces_matter) not in _ENCODERS:
        _ENCODERS[path, spaces_matter] = Encoder(path, spaces_matter)
    return _ENCODERS[path, spaces_matter]


def forget() -> None:
    """Drops the encoders of this worker process, which other operators have no use for."""
    if _ENCODERS:
        _ENCODERS.clear()
        give_back()
