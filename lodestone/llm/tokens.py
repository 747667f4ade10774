"""Token ids by the tokenizers library, with each distinct piece of text encoded once.

Texts are cut, many at once on their UTF-8 bytes, only where neither vocabulary's pattern can match across
(``tests/llm`` holds whole texts against an untouched tokenizer), so the ids of a text are those of its
pieces in order. A cut stands

* before white space that follows a character known not to be white space;
* after a single tab or line end between two such characters;
* between a letter, a digit and another sign, unless an apostrophe, which may begin a contraction, is the
  first of the two; the word-end vocabulary has each digit alone as well.

Known characters are ASCII's and the Latin-1 letters, which no Unicode version classes otherwise; around others
nothing is cut. The strings of special tokens are pieces of their own, as the library has them: their id, with
the text on either side encoded apart.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa

LETTER, DIGIT, SIGN, QUOTE, SPACE, BREAK = 1, 2, 3, 4, 5, 6  # 0: any other byte
_KIND = np.zeros(256, np.uint8)
_KIND[33:127] = SIGN
_KIND[[*range(65, 91), *range(97, 123)]] = LETTER
_KIND[48:58] = DIGIT
_KIND[39], _KIND[32], _KIND[9:14] = QUOTE, SPACE, BREAK
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_LOW[9:14] = 32
_PLAIN = re.compile(" ?[!-~À-ÖØ-öø-ÿ]+").fullmatch
#: Bytes of text cut at a time, and pieces encoded in one call.
WINDOW, RUN = 2_000_000, 512


class ChunkEncoder:
    """``runs(texts)``: the ids of whole texts.

    ``entries`` bounds the memory of the table of pieces; when full it is emptied, which changes no result.
    """

    def __init__(self, path: str, entries: int = 800_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        if self.tokenizer.get_vocab_size() > 65_536:
            raise ValueError("ids must fit 16 bits")
        self.drops_space = "Removed" in repr(self.tokenizer.pre_tokenizer)
        self.special = {t.content: k for k, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.between = " | " if self.drops_space else "\n"
        self.mark = self.tokenizer.encode(self.between, add_special_tokens=False).ids[0]
        self.entries = entries
        self._empty()

    def _empty(self) -> None:
        """The table of pieces: ``known`` gives a piece's number, by which ``begin`` and ``size`` say where in ``flat`` its ids are."""
        self.known: dict[str, int] = {}
        self.flat, self.begin, self.size = np.zeros(0, np.uint16), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._add(list(self.special), np.array(list(self.special.values()), np.uint16), np.ones(len(self.special), np.int64))

    def _add(self, pieces: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        first = len(self.size)
        self.known.update(zip(pieces, range(first, first + len(pieces))))
        self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes])
        self.flat = np.concatenate([self.flat, ids])

    def _encode(self, pieces: list[str]) -> None:
        """Pieces not met before. Those of known characters are encoded many in a call, between marks whose id no piece there makes."""
        plain = [p for p in pieces if _PLAIN(p) and not (self.drops_space and "|" in p)]
        for k in range(0, len(plain), RUN * 64):
            some = plain[k : k + RUN * 64]
            runs = self.tokenizer.encode_batch_fast([self.between.join(some[j : j + RUN]) for j in range(0, len(some), RUN)], add_special_tokens=False)
            ids = np.concatenate([np.array([*e.ids, self.mark], np.uint16) for e in runs])
            edge = np.flatnonzero(ids == self.mark)
            self._add(some, ids[ids != self.mark], np.diff(np.r_[-1, edge]) - 1)
        rest = [p for p in pieces if p not in self.known] if len(plain) < len(pieces) else []
        for k in range(0, len(rest), 100_000):
            some = rest[k : k + 100_000]
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            self._add(some, np.fromiter((i for x in ids for i in x), np.uint16, int(sizes.sum())), sizes)

    def _cuts(self, data: np.ndarray, edge: np.ndarray) -> np.ndarray:
        """Where pieces begin; ``edge``: where texts and the strings of special tokens do, and what follows those."""
        kind = _KIND[data]
        lead = np.flatnonzero(data[:-1] == 0xC3)
        lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
        kind[lead] = kind[lead + 1] = LETTER
        group = np.where(kind == QUOTE, SIGN, kind)
        sure = (kind > 0) & (kind < SPACE)
        cut = edge.copy()
        was, now = sure[:-1], sure[1:]
        cut[1:] |= was & (kind[1:] >= SPACE)
        other = group[1:] != group[:-1]
        if self.drops_space:
            other |= group[1:] == DIGIT
        cut[1:] |= now & was & other & (kind[:-1] != QUOTE)
        if not self.drops_space:
            before = np.concatenate([[True], sure[:-2]]) | edge[:-1]
            cut[1:] |= now & (kind[:-1] == BREAK) & before
        return cut

    def _window(self, data: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where pieces begin, where their ids end) of some bytes."""
        at = np.flatnonzero(cut)
        texts = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(np.append(at, len(data)).astype(np.int64)), pa.py_buffer(data)])
        coded = texts.dictionary_encode()
        pieces = coded.dictionary.to_numpy(zero_copy_only=False)  # a list of scalars costs several times as much
        if len(self.known) > self.entries:
            self._empty()
        number = np.fromiter(map(self.known.get, pieces, repeat(-1)), np.int64, len(pieces))
        new = pieces[number < 0].tolist()
        self._encode(new)
        number[number < 0] = np.fromiter(map(self.known.__getitem__, new), np.int64, len(new))
        slot = number[coded.indices.to_numpy()]
        table = pa.LargeListArray.from_arrays(np.append(self.begin, len(self.flat)), self.flat)
        return table.take(slot).flatten().to_numpy(), at, np.cumsum(self.size[slot])

    def run(self, data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds) of the texts between ``edges`` in UTF-8 bytes: text k has ids[bounds[k] : bounds[k + 1]]."""
        if not len(data):
            return np.zeros(0, np.uint16), np.zeros(len(edges), np.int64)
        edge = np.zeros(len(data) + 1, bool)
        edge[edges] = True
        raw, inside = data.tobytes() if len(self.special) else b"", []
        for content in self.special:
            token, at = content.encode(), -1
            while (at := raw.find(token, at + 1)) >= 0:
                if not edge[at + 1 : at + len(token)].any():  # not over the end of a text
                    inside.append((at, at + len(token)))
        for lo, hi in inside:
            edge[lo] = edge[hi] = True
        edge = edge[:-1]
        if self.drops_space:
            data = data.copy()
            trail = np.flatnonzero(data[:-1] == 0xC3) + 1
            trail = trail[(data[trail] >= 0x80) & (data[trail] <= 0x9E) & (data[trail] != 0x97)]
            keep = [(lo, data[lo:hi].copy()) for lo, hi in inside]
            data = _LOW[data]
            data[trail] += 32
            for lo, b in keep:
                data[lo : lo + len(b)] = b
        cut = np.zeros(len(data), bool)
        ids, begins, ends, lo, total = [], [], [], 0, 0
        while lo < len(data):
            hi, size = min(lo + WINDOW, len(data)), WINDOW
            while True:
                cut = self._cuts(data[lo:hi], edge[lo:hi])
                cut[0] = True
                for a, b in inside:
                    if b > lo and a < hi:
                        cut[max(a + 1 - lo, 0) : b - lo] = False
                if hi == len(data):
                    stop = hi
                    break
                last = np.flatnonzero(cut)[-1]
                if last:
                    stop = lo + int(last)
                    break
                size *= 2
                hi = min(lo + size, len(data))  # no place to cut: one piece so far
            got, at, end = self._window(data[lo:stop], cut[: stop - lo])
            ids.append(got)
            begins.append(at + lo)
            ends.append(end + total)
            total += len(got)
            lo = stop
        begins, ends = np.concatenate(begins), np.concatenate([[0], *ends])
        return np.concatenate(ids), ends[np.searchsorted(begins, edges)]

    def runs(self, texts: pa.Array, size: int = WINDOW):
        """(lo, hi, ids, bounds) for runs of rows lo to hi of about ``size`` bytes, so that memory follows neither the Arrow batch nor, beyond its ids, a text. No text is null."""
        texts = texts.cast(pa.large_binary())
        n = len(texts)
        edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        lo = 0
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(edges, edges[lo] + size, "right")) - 1)
            yield lo, hi, *self.run(data[edges[lo] : edges[hi]], edges[lo : hi + 1] - edges[lo])
            lo = hi

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 16-bit bytes."""
        out = []
        for lo, hi, ids, bounds in self.runs(pa.array(texts, pa.large_string())):
            out += [ids[a:b].astype("<u2").tobytes() for a, b in zip(bounds, bounds[1:])]
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> ChunkEncoder:
    """One for each Python worker and vocabulary."""
    return ChunkEncoder(path)


def vocabulary(name: str) -> str:
    """The path of a vocabulary file as each executor has it."""
    import public_tokenizers

    return public_tokenizers.path(name)
