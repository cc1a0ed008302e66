"""Tokenizing many texts with a table of pieces that were met before.

A tokenizer that cuts texts at white space and between letters and punctuation gives the same ids
for a piece between two such cuts wherever it stands. Texts are therefore cut into pieces with
numpy, equal pieces are found by two 64-bit hashes, and the tokenizers library encodes each piece
once a worker. Plain words go to the library's merge model directly, all else to its whole
pipeline. Texts with white space beyond ASCII are encoded whole, since runs of it may span pieces.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np

from worklake.llm.hashing import BLOCK, row_blocks, spans_hash

#: Pieces and ids kept by a worker, in about 64 MB; beyond, its table starts anew.
MAX_PIECES = 800_000
MAX_IDS = 4_000_000

SPACE, WHITE, LETTER, MARK, DIGIT = 1, 2, 3, 4, 5
_CLASS = np.zeros(256, np.uint8)
_CLASS[0x20] = SPACE
_CLASS[0x09:0x0E] = WHITE
for _a, _b in ((0x41, 0x5B), (0x61, 0x7B)):
    _CLASS[_a:_b] = LETTER
for _a, _b in ((0x21, 0x27), (0x28, 0x30), (0x3A, 0x41), (0x5B, 0x61), (0x7B, 0x7F)):
    _CLASS[_a:_b] = MARK
_CLASS[0x30:0x3A] = DIGIT
_IS_WHITE = np.isin(_CLASS, (SPACE, WHITE))
_LEADS = np.isin(np.arange(256), (0xC2, 0xE1, 0xE2, 0xE3))
#: White space beyond ASCII, in UTF-8 (one sign that older tables hold for white space among them).
_WIDE = re.compile(
    rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe1\xa0\x8e|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80"
)
_PLAIN = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")


def _letters() -> list[str]:
    """The sign that stands for each byte in byte-level vocabularies: itself where it can be seen."""
    seen = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in seen]
    return [chr(b) if b in seen else chr(256 + hidden.index(b)) for b in range(256)]


def _cuts(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where pieces start; the first byte of each row is one."""
    n = len(raw)
    kind = _CLASS[raw]
    accented = np.flatnonzero(raw[:-1] == 0xC3)
    accented = accented[(raw[accented + 1] != 0x97) & (raw[accented + 1] != 0xB7)]
    kind[accented] = LETTER
    kind[accented + 1] = LETTER
    white = _IS_WHITE[raw]
    cut = np.zeros(n + 1, bool)
    before, here = kind[:-1], kind[1:]
    inner = white[1:] & ~white[:-1]
    inner |= (before == LETTER) & ((here == MARK) | (here == DIGIT))
    inner |= (before == MARK) & (here == LETTER)
    alone = np.r_[True, ~white[:-1]][: n - 1] if n else inner
    inner |= (before == WHITE) & ~white[1:] & alone
    cut[1:n] = inner
    lead = np.flatnonzero(_LEADS[raw])
    if len(lead):
        for row in np.unique(np.searchsorted(at, lead, "right") - 1):
            a, b = int(at[row]), int(at[row + 1])
            if _WIDE.search(raw[a:b].tobytes()):
                cut[a:b] = False
    cut[at[:-1][at[1:] > at[:-1]]] = True
    return np.flatnonzero(cut[:n])


class Encoder:
    """Ids of texts, as the tokenizers library gives them for the file `path`."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # their strings in a text are ordinary text
        self.model = self.library.model
        self.signs = _letters()
        self.lower = self.library.normalizer is not None
        self.quick = self._agrees()
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(1 << 17, np.uint64)  # slots; 0: free
        self.entry = np.zeros(1 << 17, np.int32)
        self.n = 0
        self.first = np.zeros(1 << 16, np.uint64)
        self.second = np.zeros(1 << 16, np.uint64)
        self.begin = np.zeros((1 << 16) + 1, np.int64)
        self.ids = np.zeros(1 << 18, np.uint32)

    def _plain(self, piece: bytes) -> list[int]:
        word = piece.decode()
        if self.lower:
            word = word.lower().lstrip(" ")
        signs = self.signs
        return [t.id for t in self.model.tokenize("".join([signs[b] for b in word.encode()]))]

    def _agrees(self) -> bool:
        """Whether plain words may skip the library's pipeline: tried on words of many forms."""
        probes = ["the", " the", "Thing", " Andstreet", " éàüß", "ÉLAN", " x", "Q", " unbelievableness", "Ñandú"]
        return all(self._plain(p.encode()) == self.library.encode(p, add_special_tokens=False).ids for p in probes)

    def _learn(self, pieces: list[bytes]) -> list[list[int]]:
        out: list = [None] * len(pieces)
        rest = []
        for i, piece in enumerate(pieces):
            if self.quick and _PLAIN.fullmatch(piece):
                out[i] = self._plain(piece)
            else:
                rest.append(i)
        for k in range(0, len(rest), 512):
            part = rest[k : k + 512]
            found = self.library.encode_batch_fast([pieces[i].decode() for i in part], add_special_tokens=False)
            for i, e in zip(part, found, strict=True):
                out[i] = e.ids
        return out

    def _find(self, h1: np.ndarray) -> np.ndarray:
        """Entry of each hash, -1 where there is none."""
        mask = np.uint64(len(self.keys) - 1)
        out = np.full(len(h1), -1, np.int64)
        open_, slot = np.arange(len(h1)), (h1 & mask).astype(np.int64)
        while len(open_):
            key = self.keys[slot]
            hit = key == h1[open_]
            out[open_[hit]] = self.entry[slot[hit]]
            on = ~hit & (key != 0)
            open_, slot = open_[on], (slot[on] + 1) & int(mask)
        return out

    def _file(self, h1: np.ndarray, entries: np.ndarray) -> None:
        """Puts entries into free slots; hashes are distinct and not yet there."""
        mask = len(self.keys) - 1
        slot = (h1 & np.uint64(mask)).astype(np.int64)
        todo = np.arange(len(h1))
        while len(todo):
            free = self.keys[slot] == 0
            taken, who = np.unique(slot[free], return_index=True)
            placed = todo[free][who]
            self.keys[taken] = h1[placed]
            self.entry[taken] = entries[placed]
            left = np.ones(len(todo), bool)
            left[np.flatnonzero(free)[who]] = False
            todo, slot = todo[left], (slot[left] + 1) & mask

    def _add(self, h1: np.ndarray, h2: np.ndarray, found: list[list[int]]) -> np.ndarray:
        sizes = np.array([len(x) for x in found], np.int64)
        a, b = self.n, self.n + len(found)
        if b + 1 > len(self.begin):
            size = 1 << b.bit_length()
            for name in ("first", "second"):
                setattr(self, name, np.r_[getattr(self, name)[:a], np.zeros(size - a, np.uint64)])
            self.begin = np.r_[self.begin[: a + 1], np.zeros(size - a, np.int64)]
        self.first[a:b], self.second[a:b] = h1, h2
        self.begin[a + 1 : b + 1] = self.begin[a] + np.cumsum(sizes)
        end = int(self.begin[b])
        if end > len(self.ids):
            self.ids = np.r_[self.ids, np.zeros((1 << end.bit_length()) - len(self.ids), np.uint32)]
        self.ids[int(self.begin[a]) : end] = np.fromiter((i for x in found for i in x), np.uint32, int(sizes.sum()))
        self.n = b
        if 2 * b > len(self.keys):
            self.keys = np.zeros(2 * (1 << b.bit_length()), np.uint64)
            self.entry = np.zeros(len(self.keys), np.int32)
            self._file(self.first[:b], np.arange(b))
        else:
            self._file(h1, np.arange(a, b))
        return np.arange(a, b)

    def block(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the rows of one block, and where each row's begin."""
        if self.n > MAX_PIECES or int(self.begin[self.n]) > MAX_IDS:
            self._clear()
        starts = _cuts(raw, at)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(at), np.int64)
        ends = np.r_[starts[1:], len(raw)]
        h1 = spans_hash(raw, starts, ends, 0) | np.uint64(1)
        h2 = spans_hash(raw, starts, ends, 1)
        e = self._find(h1)
        new = np.flatnonzero(e < 0)
        if len(new):
            keys, which, back = np.unique(h1[new], return_index=True, return_inverse=True)
            one = new[which]
            pieces = [raw[a:b].tobytes() for a, b in zip(starts[one].tolist(), ends[one].tolist(), strict=True)]
            e[new] = self._add(keys, h2[one], self._learn(pieces))[back]
        odd = np.flatnonzero(self.second[e] != h2)
        if len(odd):  # two pieces with one hash: this row block is encoded plainly
            texts = [raw[a:b].tobytes().decode() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            ids = [self.library.encode(t, add_special_tokens=False).ids for t in texts]
            sizes = np.array([len(x) for x in ids], np.int64)
            return np.fromiter((i for x in ids for i in x), np.uint32, int(sizes.sum())), np.r_[0, np.cumsum(sizes)]
        begin, size = self.begin[e], self.begin[e + 1] - self.begin[e]
        total = np.r_[0, np.cumsum(size)]
        ids = self.ids[np.repeat(begin - total[:-1], size) + np.arange(int(total[-1]))]
        return ids, total[np.searchsorted(starts, at)]

    def rows(self, raw: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
        """Ids of each row, in order; a long row goes through in parts cut before white space."""
        for first, last in row_blocks(at):
            a, b = int(at[first]), int(at[last])
            if b - a <= 4 * BLOCK:
                ids, begin = self.block(raw[a:b], at[first : last + 1] - a)
                for k in range(last - first):
                    yield ids[begin[k] : begin[k + 1]]
            else:
                yield np.concatenate([self.block(p, np.array([0, len(p)]))[0] for p in _parts(raw[a:b])])


def _parts(raw: np.ndarray) -> Iterator[np.ndarray]:
    """Parts of a long text that start with white space after something else; whole if white space is odd."""
    lead = np.flatnonzero(_LEADS[raw])
    if len(lead) and _WIDE.search(raw.tobytes()):
        yield raw
        return
    a = 0
    while len(raw) - a > BLOCK:
        step = raw[a + BLOCK - 1 :]
        for size in (1 << 16, len(step)):
            white = _IS_WHITE[step[:size]]
            cut = np.flatnonzero(white[1:] & ~white[:-1])
            if len(cut):
                break
        if not len(cut):
            break
        b = a + BLOCK + int(cut[0])
        yield raw[a:b]
        a = b
    yield raw[a:]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each file and worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def crc32(ids: np.ndarray) -> int:
    """Unsigned checksum of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").data)


def vocabulary(name: str) -> str:
    """Where a public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
