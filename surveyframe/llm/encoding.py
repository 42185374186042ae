"""Token ids of slabs of text, with each distinct chunk encoded once per worker.

A chunk is a stretch of text that a public tokenizer encodes without regard to
what surrounds it; which stretches those are depends on the tokenizer:

- ``word_chunks``: runs without ASCII white space, for tokenizers that drop white
  space and split at it;
- ``space_chunks``: cut before a single space between two characters that are
  neither white space nor unknown to this rule, for byte-level tokenizers, whose
  pre-tokens begin with such a space. All other white space stays inside a chunk.
"""

from __future__ import annotations

import os
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np

from surveyframe.llm.texthash import SPACE, span, sums

#: Distinct chunks that a worker remembers; beyond, it starts anew.
REMEMBERED = 500_000
#: Bytes of chunks that ``WordEncoder`` encodes together.
JOINED = 1 << 10

PRINTING = np.zeros(256, bool)
PRINTING[0x21:0x7F] = True
LATIN = 0xC3  # lead byte of the letters from U+00C0 to U+00FF


def word_chunks(buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    space = SPACE[buf]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    start = np.flatnonzero(~space & (edge[:-1] | np.concatenate(([True], space[:-1]))))
    end = np.flatnonzero(~space & (edge[1:] | np.concatenate((space[1:], [True])))) + 1
    return start, end


def space_chunks(buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(n + 1, bool)
    if n > 2:
        solid, lead = PRINTING[buf], buf == LATIN
        before = solid[1:-1].copy()
        before[1:] |= lead[1:-2]  # position k stands for byte k + 1, the space for byte k + 2
        at = np.flatnonzero((buf[2:] == 0x20) & before) + 2
        at = at[at < n - 1]
        at = at[solid[at + 1] | lead[at + 1]]
        cut[at] = True
    cut[bounds] = True
    if n > 1 and buf[1] == 0x20 and PRINTING[buf[0]] and n > 2 and (PRINTING[buf[2]] or buf[2] == LATIN):
        cut[1] = True
    edges = np.flatnonzero(cut)
    edges = edges[(edges >= bounds[0]) & (edges <= bounds[-1])]
    return edges[:-1], edges[1:]


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.forget()

    def forget(self) -> None:
        self.hash = np.zeros(0, np.uint64)
        self.size = np.zeros(0, np.int32)
        self.at = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _encoded(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all chunks, and how many of them each chunk has."""
        got = [e.ids for e in self.tokenizer.encode_batch_fast([c.decode() for c in chunks], add_special_tokens=False)]
        size = np.fromiter(map(len, got), np.int32, len(got))
        return np.fromiter(chain.from_iterable(got), np.uint32, int(size.sum())), size

    def _learn(self, hashes: np.ndarray, chunks: list[bytes]) -> None:
        flat, size = self._encoded(chunks)
        at = len(self.ids) + np.cumsum(size, dtype=np.int64) - size
        where = np.searchsorted(self.hash, hashes)
        self.hash = np.insert(self.hash, where, hashes)
        self.size = np.insert(self.size, where, size)
        self.at = np.insert(self.at, where, at)
        self.ids = np.concatenate((self.ids, flat))

    def rows(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The place of each chunk among the remembered ones."""
        if not len(start):
            return np.zeros(0, np.int64)
        u, first, back = np.unique(span(sums(buf), start, end), return_index=True, return_inverse=True)
        if len(self.hash) + len(u) > REMEMBERED:
            self.forget()
        where = np.searchsorted(self.hash, u)
        known = np.zeros(len(u), bool)
        inside = where < len(self.hash)
        known[inside] = self.hash[where[inside]] == u[inside]
        if not known.all():
            raw, new = buf.tobytes(), first[~known]
            self._learn(u[~known], [raw[a:b] for a, b in zip(start[new].tolist(), end[new].tolist(), strict=True)])
            where = np.searchsorted(self.hash, u)
        return where[back]

    def counts(self, rows: np.ndarray) -> np.ndarray:
        return self.size[rows]

    def flat(self, rows: np.ndarray) -> np.ndarray:
        """The ids of the chunks one after another."""
        size = self.size[rows].astype(np.int64)
        shift = self.at[rows] - np.cumsum(size) + size
        return self.ids[np.repeat(shift, size) + np.arange(int(size.sum()))]


class WordEncoder(Encoder):
    """For byte-level tokenizers that drop white space and split at it: chunks are encoded many at a time.

    Chunks of printing ASCII and Latin letters are joined by spaces, some JOINED bytes at
    a time. Composing and lower-casing leave their bytes as many as they are, so the
    tokens' lengths tell where each one ends. Texts whose tokens don't end with the
    chunks, and all other chunks, are encoded each chunk for itself.

    When too many are remembered, those stay that were met in more than one slab.
    """

    def __init__(self, path: str):
        super().__init__(path)
        vocab, suffix = self.tokenizer.get_vocab(), getattr(self.tokenizer.model, "end_of_word_suffix", None) or ""
        self.length = np.zeros(max(vocab.values()) + 1, np.int64)  # bytes of a token: a character stands for each
        for piece, k in vocab.items():
            self.length[k] = len(piece.removesuffix(suffix))

    def forget(self) -> None:
        kept = np.flatnonzero(self.met > 1) if hasattr(self, "met") else ()
        if not 0 < len(kept) <= REMEMBERED // 2:
            super().forget()
        else:
            self.ids, self.size, self.hash = self.flat(kept), self.size[kept], self.hash[kept]
            self.at = np.cumsum(self.size, dtype=np.int64) - self.size
        self.met = np.zeros(len(self.hash), np.int32)  # slabs

    def rows(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        rows = super().rows(buf, start, end)
        here = np.zeros(len(self.hash), bool)
        here[rows] = True
        self.met += here
        return rows

    def _learn(self, hashes: np.ndarray, chunks: list[bytes]) -> None:
        self.met = np.insert(self.met, np.searchsorted(self.hash, hashes), 0)
        super()._learn(hashes, chunks)

    def _encoded(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        length = np.fromiter(map(len, chunks), np.int64, len(chunks))
        buf = np.frombuffer(b"".join(chunks), np.uint8)
        known, lead = PRINTING[buf], buf == LATIN
        known[lead] = True
        known[1:] |= lead[:-1]
        plain = np.flatnonzero(np.logical_and.reduceat(known, np.cumsum(length) - length))
        if not len(plain):
            return super()._encoded(chunks)
        some, length = [chunks[k] for k in plain.tolist()], length[plain]
        end = np.cumsum(length)
        first = np.flatnonzero(np.diff((end - length) // JOINED, prepend=-1))  # chunk of each text
        last = np.append(first[1:], len(some)) - 1
        text = np.repeat(np.arange(len(first)), last - first + 1)
        flat, n = super()._encoded([b" ".join(some[a:b]) for a, b in pairwise([*first.tolist(), len(some)])])
        # the token with which each chunk should end, told by the bytes before
        done = np.concatenate(([0], np.cumsum(self.length[flat])))
        begin = np.concatenate(([0], np.cumsum(n, dtype=np.int64)))
        stop = end + (done[begin[:-1]] - (end - length)[first])[text]
        at = np.searchsorted(done, stop)
        ends = done[np.minimum(at, len(done) - 1)] == stop
        sound = np.logical_and.reduceat(ends, first) & (at[last] == begin[1:])
        size = np.diff(at, prepend=0)
        size[first] = at[first] - begin[:-1]

        joined = np.zeros(len(chunks), bool)
        joined[plain] = sound[text]
        counts = np.zeros(len(chunks), np.int32)
        counts[joined] = size[sound[text]]
        single, counts[~joined] = super()._encoded([chunks[k] for k in np.flatnonzero(~joined).tolist()])
        ids, together = np.empty(int(counts.sum()), np.uint32), np.repeat(joined, counts)
        ids[together], ids[~together] = flat[np.repeat(sound, n)], single
        return ids, counts


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per tokenizer and worker."""
    return Encoder(path)


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    """One encoder per tokenizer that drops white space and worker."""
    return WordEncoder(path)
