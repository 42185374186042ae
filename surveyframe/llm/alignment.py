"""Alignment of two tokenizers' tokens over the same bytes, once for each distinct text.

Equal texts are made one by a shuffle on the full text. Each distinct text is encoded
with both tokenizers, A and B; where a token of A and one of B end at the same byte, a
group ends. Both tokenizers begin a token at a single space between printing
characters, so a text is cut there into chunks that are encoded and aligned each for
itself, and a worker remembers the chunks it has met. What a chunk gives (ids, groups,
links) is added up for its text.

Links are stored packed, a block for some megabyte of text, beside the block's distinct
(A id, B id) pairs. The pairs are counted over the corpus, each block weighing its texts
by their copies; counts come back to the blocks by a join on the pair, and the measures
of a text to the ids of all its copies by a join on its digest.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from surveyframe.llm.common import SLAB, attach, prepare, release, settled, slabs
from surveyframe.llm.encoding import space_chunks
from surveyframe.llm.texthash import span, sums

#: Distinct chunks, and links of chunks, that a worker remembers; beyond, it starts anew.
REMEMBERED, REMEMBERED_LINKS = 200_000, 4_000_000
#: Bytes of chunks that are encoded together.
JOINED = 1 << 10


def byte_level() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printing ones for themselves, the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Pieces:
    """Tokens as bytes; ``bytes`` has each id's."""

    bytes: list[bytes]

    def lay_out(self) -> None:
        self.size = np.array([len(x) for x in self.bytes], np.int64)
        self.flat, self.at = np.frombuffer(b"".join(self.bytes), np.uint8), np.cumsum(self.size) - self.size

    def joined(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of tokens one after another."""
        size = self.size[ids]
        return self.flat[np.repeat(self.at[ids] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))]


class BytePieces(Pieces):
    """Tokenizer A: a byte-level one; its special tokens' strings are plain text."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        byte = byte_level()
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.bytes = [b""] * (max(self.tokenizer.get_vocab().values()) + 1)
        for piece, k in vocab.items():
            self.bytes[k] = bytes(byte[c] for c in piece)
        self.lay_out()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


class WordPieces(Pieces):
    """Tokenizer B: pieces with U+2581 for a space, one of which it adds in front, and bytes for what has no piece."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(k) for k in range(self.model.vocab_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.lay_out()
        #: a space inside a piece would let tokens reach over a chunk's edge
        self.splits = not any("▁" in p.lstrip("▁") for p in pieces)

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Each text has the space in front that the model adds itself."""
        return self.model.encode([t[1:] for t in texts], num_threads=1)


class Aligner:
    """What each chunk gives, by its hash; chunks whose tokens don't give back its bytes are ``odd``."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = BytePieces(path_a), WordPieces(path_b)
        self.size_a, self.size_b = self.a.size, self.b.size
        names = np.arange(max(len(self.size_a), len(self.size_b))).astype("S")
        #: ids as decimals, and their digits
        self.names, self.digits = names.view(np.uint8).reshape(len(names), -1), np.char.str_len(names)
        self.forget()

    def forget(self) -> None:
        self.hash = np.zeros(0, np.uint64)
        self.row = np.zeros(0, np.int64)  # of each hash
        self.counts = np.zeros((0, 3), np.int64)  # tokens of A and B, groups
        self.odd = np.zeros(0, bool)
        self.at = np.zeros(1, np.int64)  # where the chunk's links begin
        self.links = np.zeros(0, np.int64)
        self.shown: list[bytes] = []

    def _encoded(self, tokenizer: BytePieces | WordPieces, size: np.ndarray, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all chunks, and how many of them each chunk has.

        Chunks that ``space_chunks`` would cut from each other are encoded together, some
        JOINED bytes at a time. Where the tokens don't end with the chunks, as where a
        normalisation has changed bytes, each chunk is encoded for itself.
        """
        raw, length = b"".join(chunks), np.array([len(c) for c in chunks], np.int64)
        border = np.cumsum(length)
        edges = self.chunks(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[1]
        fresh = ~np.isin(border[:-1], edges, assume_unique=True) | (np.diff((border - length) // JOINED) > 0)
        first = np.flatnonzero(np.concatenate(([True], fresh)))
        last = np.append(first[1:], len(chunks)) - 1
        at, to = (border - length)[first], border[last]
        got = tokenizer.encode([raw[x:y].decode() for x, y in zip(at.tolist(), to.tolist(), strict=True)])
        n = np.fromiter(map(len, got), np.int64, len(got))
        flat = np.fromiter(chain.from_iterable(got), np.int64, int(n.sum()))
        # where tokens end, if each text's begin with the text; a chunk has those after the last one's border
        step = size[flat]
        done = np.cumsum(step)
        before = np.concatenate(([0], done))[np.cumsum(n) - n]
        text = np.repeat(np.arange(len(got)), n)
        end = done - before[text] + at[text]
        over = np.zeros(len(got), bool)
        over[text[end > to[text]]] = True
        end[over[text]] = 0
        of = np.repeat(np.arange(len(got)), last - first + 1)
        over[of[~np.isin(border, end)]] = True
        if over.any():
            many = np.flatnonzero(over[of])
            again = tokenizer.encode([chunks[k].decode() for k in many.tolist()])
            keep = ~over[text]
            where = np.searchsorted(border, end[keep])
            count = np.bincount(where, minlength=len(chunks))
            count[many] = np.fromiter(map(len, again), np.int64, len(again))
            out, alone = np.empty(int(count.sum()), np.int64), np.repeat(over[of], count)
            out[~alone], out[alone] = flat[keep], np.fromiter(chain.from_iterable(again), np.int64, int(count[many].sum()))
            return out, count
        return flat, np.bincount(np.searchsorted(border, end), minlength=len(chunks))

    def _learn(self, chunks: list[bytes]) -> None:
        length, raw = np.array([len(c) for c in chunks], np.int64), np.frombuffer(b"".join(chunks), np.uint8)
        odd, ids = np.zeros(len(chunks), bool), []
        for tokenizer, size in ((self.a, self.size_a), (self.b, self.size_b)):
            flat, n = self._encoded(tokenizer, size, chunks)
            ids.append((flat, n))
            done = np.concatenate(([0], np.cumsum(size[flat])))[np.concatenate(([0], np.cumsum(n)))]
            as_long = np.diff(done) == length
            odd |= ~as_long
            owner = np.repeat(np.flatnonzero(as_long), length[as_long])
            odd[owner[tokenizer.joined(flat[np.repeat(as_long, n)]) != raw[np.repeat(as_long, length)]]] = True
        (flat_a, n_a), (flat_b, n_b) = ((flat[np.repeat(~odd, n)], np.where(odd, 0, n)) for flat, n in ids)
        end_a, end_b = np.cumsum(self.size_a[flat_a]), np.cumsum(self.size_b[flat_b])
        # parts between the ends of tokens of either: each is a link
        ends = np.union1d(end_a, end_b)
        links = flat_a[np.searchsorted(end_a, ends)] << 32 | flat_b[np.searchsorted(end_b, ends)] if len(ends) else np.zeros(0, np.int64)
        both = np.intersect1d(end_a, end_b, assume_unique=True)
        border = np.cumsum(np.where(odd, 0, length))
        groups = np.diff(np.searchsorted(both, border, "right"), prepend=0)
        begin = np.searchsorted(ends, border, "right")
        # the groups, written out: A's ids of a group, then B's; each with what follows it
        cut_a, cut_b = np.searchsorted(end_a, both, "right"), np.searchsorted(end_b, both, "right")
        flat, follows = np.empty(len(flat_a) + len(flat_b), np.int64), np.full(len(flat_a) + len(flat_b), ord(","), np.uint8)
        flat[np.arange(len(flat_a)) + np.repeat(np.diff(cut_b, prepend=0).cumsum() - np.diff(cut_b, prepend=0), np.diff(cut_a, prepend=0))] = flat_a
        flat[np.arange(len(flat_b)) + np.repeat(cut_a, np.diff(cut_b, prepend=0))] = flat_b
        follows[cut_a - 1 + cut_b - np.diff(cut_b, prepend=0)], follows[cut_a + cut_b - 1] = ord("|"), ord(";")
        digits = self.digits[flat]
        written = np.empty((len(flat), self.names.shape[1] + 1), np.uint8)
        written[:, :-1] = self.names[flat]
        written[np.arange(len(flat)), digits] = follows
        written = written[np.arange(written.shape[1]) <= digits[:, None]].tobytes()
        last = np.concatenate(([0], np.cumsum(digits + 1)))[np.concatenate(([0], np.cumsum(n_a + n_b)))].tolist()
        self.shown += [written[x : y - 1] if y > x else b"" for x, y in pairwise(last)]
        self.counts = np.concatenate((self.counts, np.column_stack((n_a, n_b, groups))))
        self.odd = np.concatenate((self.odd, odd))
        self.at = np.concatenate((self.at, self.at[-1] + begin))
        self.links = np.concatenate((self.links, links))

    def rows(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The row of each chunk among the remembered ones."""
        if not len(start):
            return np.zeros(0, np.int64)
        u, first, back = np.unique(span(sums(buf), start, end), return_index=True, return_inverse=True)
        if len(self.hash) + len(u) > REMEMBERED or len(self.links) > REMEMBERED_LINKS:
            self.forget()
        known = np.isin(u, self.hash, assume_unique=True)
        if not known.all():
            raw, new = buf.tobytes(), first[~known]
            row = len(self.shown) + np.arange(len(new))
            self._learn([raw[a:b] for a, b in zip(start[new].tolist(), end[new].tolist(), strict=True)])
            where = np.searchsorted(self.hash, u[~known])
            self.hash, self.row = np.insert(self.hash, where, u[~known]), np.insert(self.row, where, row)
        return self.row[np.searchsorted(self.hash, u)][back]

    def links_of(self, rows: np.ndarray) -> np.ndarray:
        """The links of the chunks one after another."""
        size = self.at[rows + 1] - self.at[rows]
        return self.links[np.repeat(self.at[rows] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))]

    def chunks(self, buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return space_chunks(buf, bounds) if self.b.splits else (bounds[:-1][np.diff(bounds) > 0], bounds[1:][np.diff(bounds) > 0])


@lru_cache(maxsize=1)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def _steps(start: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of chunks of some SLAB bytes each."""
    at = 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(end, start[at] + SLAB, "right")))
        yield at, to
        at = to


def pack_links(text: np.ndarray, pair: np.ndarray, n: int) -> bytes:
    """Links (text, place of the pair in the block) in order of both, as differences, compressed."""
    order = np.lexsort((pair, text))
    pair, size = pair[order], np.bincount(text, minlength=n)
    delta = np.diff(pair, prepend=0)
    first = (np.cumsum(size) - size)[size > 0]
    delta[first] = pair[first]  # each text anew
    return zstandard.compress(np.concatenate((size, delta)).astype("<u4").tobytes(), 3)


def unpack_links(raw: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    got = np.frombuffer(zstandard.decompress(raw), "<u4").astype(np.int64)
    size, delta = got[:n], got[n:]
    text = np.repeat(np.arange(n), size)
    run = np.cumsum(delta)
    first = np.cumsum(size) - size
    base = np.where(size > 0, run[np.minimum(first, max(len(run) - 1, 0))] - delta[np.minimum(first, max(len(run) - 1, 0))], 0) if len(run) else size
    return text, run - np.repeat(base, size)


BLOCK = "block long, texts array<binary>, n_a array<long>, n_b array<long>, n_groups array<long>, digests array<string>, pairs array<long>, counts array<long>, links binary"
SCHEMA = pa.schema(
    [("block", pa.int64()), ("texts", pa.list_(pa.binary())), *((c, pa.list_(pa.int64())) for c in ("n_a", "n_b", "n_groups")),
     ("digests", pa.list_(pa.string())), ("pairs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("links", pa.binary())]
)


def _align(path_a: str, path_b: str):
    """(key, copies, text), the added space in front of each text, to packed blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, al = TaskContext.get().partitionId() << 32, aligner(path_a, path_b)
        for batch in batches:
            for lo, hi, buf, bounds in slabs(batch):
                keys = batch.column("key").slice(lo, hi - lo)
                copies = batch.column("copies").slice(lo, hi - lo).to_numpy()
                start, end = al.chunks(buf, bounds)
                owner = np.searchsorted(bounds, start, "right") - 1
                steps = list(_steps(start, end))
                odd, hashes = np.zeros(hi - lo, bool), [hashlib.sha256() for _ in range(hi - lo)]
                begun = np.zeros(hi - lo, bool)
                for turn in (0, 1) if len(steps) > 1 else (1,):  # a long text's oddity must be known before its links are
                    for at, to in steps:
                        base = start[at]
                        rows = al.rows(buf[base : end[to - 1]], start[at:to] - base, end[at:to] - base)
                        text = owner[at:to]
                        odd[text[al.odd[rows]]] = True
                        if not turn:
                            continue
                        here = np.unique(text)
                        own = [np.bincount(text, al.counts[rows, c], hi - lo).astype(np.int64)[here] * ~odd[here] for c in range(3)]
                        cuts = np.searchsorted(text, here).tolist()
                        for t, a, b in zip(here.tolist(), cuts, [*cuts[1:], len(rows)], strict=True):
                            hashes[t].update((b";" if begun[t] else b"") + b";".join([al.shown[r] for r in rows[a:b].tolist()]))
                        begun[here] = True
                        ends = np.isin(here, owner[to:], invert=True)
                        digests = ["" if odd[t] else hashes[t].hexdigest() if done else None for t, done in zip(here.tolist(), ends.tolist(), strict=True)]
                        rows, text = rows[~odd[text]], text[~odd[text]]
                        link = al.links_of(rows)
                        of = np.repeat(np.searchsorted(here, text), al.at[rows + 1] - al.at[rows])
                        pairs, pair = np.unique(link, return_inverse=True)
                        counts = np.zeros(len(pairs), np.int64)
                        np.add.at(counts, pair, copies[here][of])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([block], pa.int64()), *(pa.array([x], SCHEMA.field(k).type) for k, x in (
                                ("texts", keys.take(pa.array(here)).to_pylist()), ("n_a", own[0]), ("n_b", own[1]), ("n_groups", own[2]),
                                ("digests", digests), ("pairs", pairs), ("counts", counts), ("links", pack_links(of, pair, len(here)))))],
                            schema=SCHEMA,
                        )
                        block += 1

    return run


def _measure(block: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
    """One block and what is known of its pairs: the measures of its texts."""
    columns = ["key", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    out = []
    for row in block.itertuples():
        n = len(row.texts)
        text, pair = unpack_links(row.links, n)
        count, best = np.zeros(len(row.pairs), np.int64), np.zeros(len(row.pairs), np.int64)
        at = known["at"].to_numpy()
        count[at], best[at] = known["n"].to_numpy(), known["best"].to_numpy()
        total = np.zeros(n, np.int64)
        np.add.at(total, text, count[pair])
        out.append(
            pd.DataFrame(
                dict(zip(columns, (list(row.texts), row.n_a, row.n_b, row.n_groups, np.bincount(text, minlength=n), np.bincount(text[best[pair] == 1], minlength=n), total, list(row.digests)), strict=True))
            )
        )
    return pd.concat(out) if out else pd.DataFrame(columns=columns)


MEASURES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def align_tokens(docs: DataFrame, path_a: str, path_b: str, *, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The measures of every row of ``docs``, and the corpus's pairs (a, b, n, best).

    ``path_a`` names a byte-level vocabulary and ``path_b`` a model that puts a space in
    front; both encode a space and the text, without special tokens. Measures: id, n_a,
    n_b, n_groups, n_links, n_best, count_sum, groups_sha256. A link is a token of A and
    one of B that share bytes, a pair's n the number of links that hold it, copies of a
    text counted each, and best tells whether no other pair of its B id has a higher n.

    Null and empty texts, and texts whose tokens don't give back their bytes (such as
    those with U+2581), have no tokens: zeros, and an empty ``groups_sha256``. Repeated
    rows and ids and null ids are rows like any others; other columns are ignored. An
    empty table gives an empty result. Texts are told apart by themselves while they are
    shuffled, afterwards by their SHA-256.
    """
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    texts = docs.where("text <> ''").groupBy("text").agg(F.count("*").alias("copies"))
    texts = texts.select(F.unhex(F.sha2("text", 256)).alias("key"), "copies", F.concat(F.lit(" "), F.col("text")).alias("text"))
    blocks = settled(texts.mapInArrow(_align(path_a, path_b), BLOCK), "blocks")
    release(spark)

    counted = blocks.select(F.inline(F.arrays_zip("pairs", "counts"))).groupBy("pairs").agg(F.sum("counts").alias("n"))
    counted = counted.select("pairs", F.shiftright("pairs", 32).alias("a"), F.col("pairs").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b"), "n")
    # at most one row for each id of A
    top = Window.partitionBy("b")
    pairs = settled(counted.withColumn("best", (F.col("n") == F.max("n").over(top)).cast("int")), "pairs")

    asked = blocks.select(F.col("block").alias("of"), F.posexplode("pairs").alias("at", "pairs"))
    known = asked.join(pairs.select("pairs", "n", "best"), "pairs").select("of", "at", "n", "best")
    kept = blocks.select("block", "texts", "n_a", "n_b", "n_groups", "digests", "pairs", "links")
    schema = "key binary, " + ", ".join(f"{c} long" for c in MEASURES) + ", groups_sha256 string"
    parts = kept.groupBy("block").cogroup(known.groupBy("of")).applyInPandas(_measure, schema)
    # a long text has parts in several blocks
    of_text = parts.groupBy("key").agg(*(F.sum(c).alias(c) for c in MEASURES), F.max("groups_sha256").alias("groups_sha256"))

    rows = docs.select("id", F.when(F.col("text") != "", F.unhex(F.sha2("text", 256))).alias("key"))
    weight = rows.where("key is not null").groupBy("key").agg(F.count("*").alias("copies"))
    of_text = settled(of_text.join(weight, "key"), "measures")
    release(spark)
    done = attach(rows.where("key is not null"), of_text, "key", "copies").unionByName(rows.where("key is null"), allowMissingColumns=True)
    out = done.select(F.col("id").alias(id_col), *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in MEASURES), F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
    return out, pairs.select("a", "b", "n", (F.col("best") == 1).alias("best"))
