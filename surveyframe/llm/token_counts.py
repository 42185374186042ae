"""Token counts that follow edits, by segment trees over pre-tokens.

A text is split into chunks that its tokenizer encodes independently (see
``encoding``), and every ``LEAF`` chunks make a leaf. The tree over the leaves holds,
for each subtree, its bytes and its tokens. An edit finds its leaves by descending
along the byte sums. Only those are encoded again, together with the chunk on
either side, since an edit may join chunks or part them; what is encoded anew grows
until both its ends are chunk borders in the new text. The new leaves replace the
old ones and the sums above are updated; nothing else is encoded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyframe.llm.common import prepare, slabs
from surveyframe.llm.encoding import LATIN, Encoder, encoder, space_chunks

#: Chunks of a leaf.
LEAF = 16
#: Bytes on either side of a cut that decide whether it is a chunk border.
REACH = 4


class Tree:
    """Sums of bytes and tokens over a document's leaves, a list of subtree sums each.

    Node k has the children 2k and 2k + 1; leaves begin at ``width``. What an edit
    adds goes to the leaf where it begins.
    """

    def __init__(self, sizes: list[int], tokens: list[int]):
        self.width = 1 << max(0, (max(1, len(sizes)) - 1).bit_length())
        self.bytes, self.tokens = self._sums(sizes), self._sums(tokens)

    def _sums(self, own: list[int]) -> list[int]:
        sums = [0] * self.width + list(own) + [0] * (self.width - len(own))
        for k in range(self.width - 1, 0, -1):
            sums[k] = sums[2 * k] + sums[2 * k + 1]
        return sums

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds byte ``at`` and the byte where it begins; the last one with bytes at the end."""
        at, k, begin = min(at, self.bytes[1] - 1), 1, 0
        while k < self.width:
            k *= 2
            if at - begin >= self.bytes[k]:
                begin += self.bytes[k]
                k += 1
        return k - self.width, begin

    def set(self, leaf: int, size: int, tokens: int) -> None:
        k = self.width + leaf
        size, tokens = size - self.bytes[k], tokens - self.tokens[k]
        while k and (size or tokens):
            self.bytes[k] += size
            self.tokens[k] += tokens
            k //= 2


def _leaves(e: Encoder, buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Leaves of the texts of a slab: each one's text, bytes and tokens."""
    start, end = space_chunks(buf, bounds)
    counts = e.counts(e.rows(buf, start, end))
    if not len(start):
        none = np.zeros(0, np.int64)
        return none, none, none
    text = np.searchsorted(bounds, start, "right") - 1
    first = np.searchsorted(start, bounds[text])
    new = (np.arange(len(start)) - first) % LEAF == 0
    at = np.flatnonzero(new)
    return text[at], np.add.reduceat(end - start, at), np.add.reduceat(counts.astype(np.int64), at)


def _build(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, tokens = [], []
            for at, to, buf, bounds in slabs(batch):
                text, size, count = _leaves(encoder(path), buf, bounds)
                cuts = np.searchsorted(text, np.arange(1, to - at))
                sizes += np.split(size, cuts)
                tokens += np.split(count, cuts)
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("id", "text", "edits")), pa.array(sizes, kind), pa.array(tokens, kind)],
                names=["id", "text", "edits", "leaf_bytes", "leaf_tokens"],
            )

    return run


def _counts(e: Encoder, texts: list[bytes]) -> list[int]:
    """Tokens of each text, all told together."""
    buf = np.frombuffer(b"".join(texts), np.uint8)
    bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    start, end = space_chunks(buf, bounds)
    total = np.concatenate(([0], np.cumsum(e.counts(e.rows(buf, start, end)), dtype=np.int64)))
    return np.diff(total[np.searchsorted(start, bounds)]).tolist()


def is_border(text: bytes, at: int) -> bool:
    """Whether a chunk may begin at byte ``at``: the rule of ``space_chunks`` for one place."""
    if at <= 0 or at >= len(text):
        return True
    if text[at] != 0x20 or at + 1 >= len(text):
        return False
    before = 0x21 <= text[at - 1] < 0x7F or at > 1 and text[at - 2] == LATIN
    return before and (0x21 <= text[at + 1] < 0x7F or text[at + 1] == LATIN)


class Document:
    """A text in the making, its tree, and the part of it that waits to be encoded again."""

    def __init__(self, text: str, sizes: list[int], tokens: list[int]):
        self.text, self.raw, self.tree = text, text.encode(), Tree(sizes, tokens)
        self.encoded = self.edits = 0

    def edit(self, at: int, remove: int, insert: str) -> bytes:
        """Apply an edit in characters; what has to be encoded anew, from border to border."""
        at = min(at, len(self.text))
        head, gone = self.text[:at], self.text[at : at + remove]
        lo, cut, n = len(head.encode()), len(gone.encode()), len(self.raw)
        self.text = f"{head}{insert}{self.text[at + remove :]}"
        self.raw = self.text.encode()
        grown, tree = len(self.raw) - n, self.tree
        if n:
            left, begin = tree.find(max(0, lo - REACH))
            right, last = tree.find(min(n - 1, lo + cut + REACH))
            stop = last + tree.bytes[tree.width + right]
            while not is_border(self.raw, begin):
                left, begin = tree.find(begin - 1)
            while stop < n and not is_border(self.raw, stop + grown):
                right, last = tree.find(stop)
                stop = last + tree.bytes[tree.width + right]
        else:
            left = right = begin = stop = 0
        self.waits = (left, right, stop + grown - begin)
        self.edits += 1
        return self.raw[begin : stop + grown]

    def settle(self, tokens: int) -> None:
        """The first leaf touched takes what was encoded anew, the others become empty."""
        left, right, size = self.waits
        self.encoded += size
        self.tree.set(left, size, tokens)
        for leaf in range(left + 1, right + 1):
            self.tree.set(leaf, 0, 0)


def _valid(edits: list | None) -> list[tuple[int, int, str]]:
    some = [x for x in edits or [] if x is not None and x["at"] is not None and x["at"] >= 0]
    return [(x["at"], max(0, x["remove"] or 0), x["insert"] or "") for x in some]


def _apply(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("text", "leaf_bytes", "leaf_tokens"))
            docs = [Document(t or "", sizes, tokens) for t, sizes, tokens in zip(*columns, strict=True)]
            before = [d.tree.tokens[1] for d in docs]
            edits = [_valid(x) for x in batch.column("edits").to_pylist()]
            for turn in range(max(map(len, edits), default=0)):  # each document's next edit, encoded together
                own = [k for k, x in enumerate(edits) if len(x) > turn]
                anew = [docs[k].edit(*edits[k][turn]) for k in own]
                for k, tokens in zip(own, _counts(e, anew), strict=True):
                    docs[k].settle(tokens)
            rows = [(b, d.tree.tokens[1], d.tree.bytes[1], d.encoded, d.edits, d.text) for b, d in zip(before, docs, strict=True)]
            names = ["tokens_before", "tokens", "n_bytes", "bytes_encoded", "n_edits", "text"]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            kinds = [pa.int64()] * 5 + [pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=["id", *names])

    return run


EDITS = "array<struct<at: long, remove: long, insert: string>>"


def count_tokens(docs: DataFrame, edits: Column, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, tokens_before, tokens, n_bytes, bytes_encoded, n_edits, text) for every row of ``docs``.

    ``edits`` is an array of (at, remove, insert) in characters, applied to the row's
    text one after another, each to what the one before left; places beyond the end
    are the end. ``path`` names the file of a public byte-level tokenizer; counts are
    those of the whole text without special tokens. Null texts count as empty. Edits
    that are null or have a null or negative place are skipped; a null length is 0, a
    null insert empty, a null array no edits. Repeated rows and null ids are rows like
    any others; other columns are ignored. An empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), edits.cast(EDITS).alias("edits"))
    kind = docs.schema["id"].dataType.simpleString()
    trees = docs.mapInArrow(_build(path), f"id {kind}, text string, edits {EDITS}, leaf_bytes array<long>, leaf_tokens array<long>")
    fields = "tokens_before long, tokens long, n_bytes long, bytes_encoded long, n_edits long, text string"
    return trees.mapInArrow(_apply(path), f"id {kind}, {fields}").withColumnRenamed("id", id_col)
