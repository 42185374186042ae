"""Removal of long repeated byte strings by merging the shards' Burrows-Wheeler orders.

Suffixes are sampled: anchors are the positions whose gram hash is the least of some
``r`` in a row, so whether a position is an anchor depends on the ``r`` grams to its
left and right alone, and every string of ``length`` bytes has its first anchor at
the same offset wherever it occurs. Each window of ``length`` bytes belongs to that
anchor. A shard (a slab of texts) sorts its anchored suffixes and keeps beside each
what a Burrows-Wheeler transform keeps, the context that precedes it.

The shards' orders are merged by refining their interleave, without sorting all
suffixes again; buckets that are settled drop out of every later round:

1. by the common prefix of ``length - 2 r + 2`` bytes that all windows of an anchor
   share: an anchor alone in its bucket owns no repeated window;
2. within a bucket, by the context before and after that all the anchor's windows
   cover: what is found twice is a repeated interval, with all of its windows;
3. for what is left, the ends of repeated intervals, by every single window; each
   different context of such a bucket sends its windows once for each shard.

Equal texts are one row before they are dealt into shards: such a text is repeated
as a whole, and stands for its copies towards all others.

The buckets are in the order of hashes, since only equality matters here. One
symbol a round, as in the original, would cost as many shuffles as the longest
common prefix; the rounds here take a few hundred bytes each.

Strings may be of words instead of bytes: the symbols are then the words, whatever
white space is between them, and ``length`` counts words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyframe.llm.common import attach, done_with, id_bits, keep_bits, may_be_listed, prepare, release, settled, slabs
from surveyframe.llm.encoding import word_chunks
from surveyframe.llm.texthash import U, mix, running, span, sums

#: Anchors whose keys one group sorts at a time.
RANGE = 250_000


def geometry(length: int) -> tuple[int, int]:
    """(grams in a row, bytes of a gram) for windows of ``length`` bytes: 3 r + w - 3 <= length."""
    if length < 8:
        raise ValueError("length must be at least 8")
    return max(2, length // 6), min(16, length // 4)


def _slide(x: np.ndarray, r: int, pick) -> np.ndarray:
    """pick over r values in a row, by doubling."""
    step = 1
    while step * 2 <= r:
        x = pick(x[:-step], x[step:])
        step *= 2
    return pick(x[: len(x) - (r - step)], x[r - step :]) if r > step else x


def symbols(buf: np.ndarray, bounds: np.ndarray, words: bool) -> tuple[np.ndarray, np.ndarray]:
    """The running sums over a slab's bytes or words, and each text's bounds among them."""
    if not words:
        return sums(buf), bounds
    start, end = word_chunks(buf, bounds)
    return running(span(sums(buf), start, end)), np.searchsorted(start, bounds)


def anchors(run: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """For each anchor that owns windows: its text, position, first and last window."""
    r, w = geometry(length)
    none = np.zeros(0, np.int64)
    if len(run) - 1 < length:
        return none, none, none, none
    at = np.arange(len(run) - w)
    h = np.maximum((span(run, at, at + w) >> U(32)).astype(np.uint32), 1)  # zero marks what leaves its text
    least = _slide(h, r, np.minimum)
    end = np.repeat(bounds[1:], np.diff(bounds))[: len(least)]  # of the text at each position
    least[np.arange(len(least)) + (r - 1 + w) > end] = 0  # such a run of grams leaves its text
    padded = np.concatenate((np.zeros(r - 1, np.uint32), least, np.zeros(r - 1, np.uint32)))
    most = _slide(padded, r, np.maximum)
    p = np.flatnonzero((most == h) & (most > 0))
    text = np.searchsorted(bounds, p, "right") - 1
    fits = np.diff(bounds)[text] >= length
    p, text = p[fits], text[fits]
    first = np.concatenate(([True], text[1:] != text[:-1])) if len(p) else np.zeros(0, bool)
    lo = np.where(first, bounds[text], np.concatenate(([0], p[:-1])) - r + 2)
    lo = np.maximum(lo, bounds[text])
    hi = np.minimum(p - r + 1, bounds[text + 1] - length)
    own = lo <= hi
    return text[own], p[own], lo[own], hi[own]


def _prefix(run: np.ndarray, p: np.ndarray, length: int) -> np.ndarray:
    r, _ = geometry(length)
    return span(run, p, p + length - 2 * r + 2)


def _range_of(key: np.ndarray, ranges: int) -> np.ndarray:
    return ((key >> U(32)) * U(ranges) >> U(32)).astype(np.int64)


SHARDS = "shard long, range long, prefixes binary, contexts binary, twice binary, keys binary, owned binary, windows binary, offsets binary, which binary"


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
    """The different pairs in order, whether each is there several times, and which of them each row has."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
    group = np.cumsum(new) - 1
    which = np.empty(len(a), np.int32)
    which[order] = group
    return a[new], b[new], np.bincount(group) > 1, which


def _keys(batch: pa.RecordBatch, at: int, end: int) -> bytes:
    return b"".join(batch.column("key").slice(at, end - at).cast(pa.binary()).to_pylist())


def _shards(length: int, ranges: int, words: bool):
    """For each shard one row with its anchors, and its different keys in order by range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at, end, buf, bounds in slabs(batch):
                shard += 1
                total, bounds = symbols(buf, bounds, words)
                text, p, lo, hi = anchors(total, bounds, length)
                if not len(p):
                    continue
                prefix = _prefix(total, p, length)
                context = mix(span(total, lo, hi + length) + (p - lo).astype(np.uint64) * U(0x9FB21C651E98DF25))
                prefix, context, twice, which = _distinct(prefix, context)
                part = _range_of(prefix, ranges)
                cut = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
                spans = list(zip(cut.tolist(), [*cut[1:].tolist(), len(part)], strict=True))
                keys = _keys(batch, at, end)
                n = len(spans)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([shard] * (n + 1), pa.int64()),
                        pa.array([None, *part[cut].tolist()], pa.int64()),
                        pa.array([None, *(prefix[a:b].tobytes() for a, b in spans)], pa.binary()),
                        pa.array([None, *(context[a:b].tobytes() for a, b in spans)], pa.binary()),
                        pa.array([None, *(twice[a:b].tobytes() for a, b in spans)], pa.binary()),
                        pa.array([keys, *[None] * n], pa.binary()),
                        pa.array([np.bincount(text, minlength=end - at).astype(np.int32).tobytes(), *[None] * n], pa.binary()),
                        pa.array([(hi - lo + 1).astype(np.int16).tobytes(), *[None] * n], pa.binary()),
                        pa.array([(p - lo).astype(np.int16).tobytes(), *[None] * n], pa.binary()),
                        pa.array([which.tobytes(), *[None] * n], pa.binary()),
                    ],
                    names=["shard", "range", "prefixes", "contexts", "twice", "keys", "owned", "windows", "offsets", "which"],
                )

    return run


def _same_as_neighbour(*keys: np.ndarray) -> np.ndarray:
    """Of sorted rows, those whose keys are found more than once."""
    same = np.logical_and.reduce([k[1:] == k[:-1] for k in keys])
    return np.concatenate((same, [False])) | np.concatenate(([False], same))


def _interleave(key: tuple, blocks: pd.DataFrame) -> pd.DataFrame:
    """Merge the shards' sorted blocks of one range; a byte for each different key in its shard's order.

    Bit 0: its context is repeated. Bit 1: its windows must be told one by one.
    """
    blocks = blocks.sort_values("shard", ignore_index=True)
    prefix = np.concatenate([np.frombuffer(x, np.uint64) for x in blocks["prefixes"]])
    context = np.concatenate([np.frombuffer(x, np.uint64) for x in blocks["contexts"]])
    flags = np.concatenate([np.frombuffer(x, np.uint8) for x in blocks["twice"]])  # repeated within a shard
    order = np.argsort(prefix, kind="stable")  # round 1: the runs are sorted already
    order = order[_same_as_neighbour(prefix[order])]
    order = order[np.lexsort((context[order], prefix[order]))]  # round 2: open buckets only
    a, b = prefix[order], context[order]
    repeated = _same_as_neighbour(a, b) if len(a) else np.zeros(0, bool)
    flags[order] |= repeated
    if len(a):
        bucket = np.cumsum(np.concatenate(([0], a[1:] != a[:-1])))
        new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        several = np.bincount(bucket, weights=new)[bucket] > 1
        flags[order[new & several]] |= 2  # one of each context
    cuts = np.cumsum([len(x) // 8 for x in blocks["prefixes"]])[:-1]
    return pd.DataFrame({"shard": blocks["shard"], "range": key[0], "flags": [x.tobytes() for x in np.split(flags, cuts)]})


def _runs(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge sorted ranges [start, end) that touch."""
    if not len(start):
        return start, end
    far = np.maximum.accumulate(end)
    new = np.concatenate(([True], start[1:] > far[:-1]))
    last = np.concatenate((np.flatnonzero(new)[1:] - 1, [len(start) - 1]))
    return start[new], far[last]


def _by_text(key: tuple, shards: pd.DataFrame, flags: pd.DataFrame) -> pd.DataFrame:
    """Texts with repeated or open windows: ranges of repeated window starts, and anchors whose windows are to be told."""
    out: list[tuple] = []
    for s in shards.itertuples() if len(flags) else ():
        got = np.frombuffer(b"".join(flags.sort_values("range")["flags"]), np.uint8)
        which = np.frombuffer(s.which, np.int32)
        flag = got[which]
        again = np.ones(len(flag), bool)
        again[np.unique(which, return_index=True)[1]] = False
        flag[again] &= 1  # one of each context is told window by window
        owned = np.frombuffer(s.owned, np.int32)
        ends = np.cumsum(owned)
        size, off = (np.frombuffer(x, np.int16).astype(np.int64) for x in (s.windows, s.offsets))
        total = np.cumsum(size) - size
        some = np.add.reduceat(np.append(flag > 0, False).astype(np.int64), np.minimum(ends - owned, len(flag))) * (owned > 0)
        for k in np.flatnonzero(some).tolist():
            a, b = ends[k] - owned[k], ends[k]
            lo, f = total[a:b] - total[a], flag[a:b]
            sure, tell = f & 1 == 1, f & 2 == 2
            start, end = _runs(lo[sure], (lo + size[a:b])[sure])
            told = np.stack((lo, size[a:b], off[a:b], (f & 1).astype(np.int64)), 1)[tell]
            out.append((s.keys[16 * k : 16 * k + 16], np.stack((start, end), 1).tobytes(), told.tobytes() if len(told) else None))
    return pd.DataFrame(out, columns=["key", "sure", "told"])


def _flagged(bits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = keep_bits(batch.column("h").to_numpy(), bits.value)
            yield batch.filter(pa.array(keep)).select(["key", "text"])

    return run


WINDOWS = "shard long, range long, hashes binary, prefixes binary, twice binary, keys binary, texts binary, starts binary, which binary"


def _windows(length: int, ranges: int, words: bool):
    """Round 3: for each slab one row with its windows to be told, and their different hashes by range.

    Ranges are of the window's own hash, so the windows of a frequent prefix are dealt over all of them,
    and a window that a slab holds many times is sent once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId() << 32
        for batch in batches:
            tell = batch.column("told").to_pylist()
            for at, end, buf, bounds in slabs(batch):
                shard += 1
                total, bounds = symbols(buf, bounds, words)
                told = [np.unique(np.frombuffer(x, np.int64).reshape(-1, 4), axis=0) for x in tell[at:end]]
                text = np.repeat(np.arange(end - at, dtype=np.int32), [len(x) for x in told])
                lo, size, off, sure = np.concatenate(told).T
                base = bounds[text]
                start = np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum())
                i = start + np.repeat(base, size)
                prefix = np.repeat(_prefix(total, base + lo + off, length), size)
                hashes, prefix, twice, which = _distinct(span(total, i, i + length), prefix)
                part = _range_of(hashes, ranges)
                cut = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
                spans = list(zip(cut.tolist(), [*cut[1:].tolist(), len(part)], strict=True))
                n, is_open = len(spans), np.repeat(sure == 0, size)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([shard] * (n + 1), pa.int64()),
                        pa.array([None, *part[cut].tolist()], pa.int64()),
                        pa.array([None, *(hashes[a:b].tobytes() for a, b in spans)], pa.binary()),
                        pa.array([None, *(prefix[a:b].tobytes() for a, b in spans)], pa.binary()),
                        pa.array([None, *(twice[a:b].tobytes() for a, b in spans)], pa.binary()),
                        pa.array([_keys(batch, at, end), *[None] * n], pa.binary()),
                        pa.array([np.repeat(text, size)[is_open].tobytes(), *[None] * n], pa.binary()),
                        pa.array([start[is_open].tobytes(), *[None] * n], pa.binary()),
                        pa.array([which[is_open].tobytes(), *[None] * n], pa.binary()),
                    ],
                    names=["shard", "range", "hashes", "prefixes", "twice", "keys", "texts", "starts", "which"],
                )

    return run


def _tell(key: tuple, blocks: pd.DataFrame) -> pd.DataFrame:
    """Whether each window of one range of hashes is found at another place too."""
    h, prefix = (np.frombuffer(b"".join(blocks[c]), np.uint64) for c in ("hashes", "prefixes"))
    found = np.frombuffer(b"".join(blocks["twice"]), bool).copy()
    order = np.lexsort((prefix, h))
    found[order] |= _same_as_neighbour(h[order], prefix[order])
    cuts = np.cumsum([len(x) for x in blocks["twice"]])[:-1]
    return pd.DataFrame({"shard": blocks["shard"], "range": key[0], "flags": [x.tobytes() for x in np.split(found, cuts)]})


def _starts(key: tuple, shards: pd.DataFrame, flags: pd.DataFrame) -> pd.DataFrame:
    """The starts of a slab's open windows that are found elsewhere too, by text."""
    out: list[tuple] = []
    for s in shards.itertuples():
        found = np.frombuffer(b"".join(flags.sort_values("range")["flags"]), bool)[np.frombuffer(s.which, np.int32)]
        text, start = np.frombuffer(s.texts, np.int32)[found], np.frombuffer(s.starts, np.int64)[found]
        some, cuts = np.unique(text, return_index=True)
        out += [(s.keys[16 * k : 16 * k + 16], x.tobytes()) for k, x in zip(some.tolist(), np.split(start, cuts[1:]), strict=bool(len(some)))]
    return pd.DataFrame(out, columns=["key", "starts"])


def _cut(length: int, words: bool, texts: bool):
    """Each flagged text without its repeated bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text, sure, copied, more in zip(*(batch.column(c).to_pylist() for c in ("key", "text", "sure", "copied", "starts")), strict=True):
                raw = np.frombuffer(text.encode(), np.uint8)
                lo, hi = np.frombuffer(sure or b"", np.int64).reshape(-1, 2).T
                one = np.frombuffer(more or b"", np.int64)
                lo, hi = np.concatenate((lo, one)), np.concatenate((hi, one + 1))
                if words:
                    first, last = word_chunks(raw, np.array([0, len(raw)]))
                if copied:  # all of its windows are found in its copies
                    windows = (len(first) if words else len(raw)) - length + 1
                    lo, hi = (np.array([x] * (windows > 0), np.int64) for x in (0, windows))
                o = np.argsort(lo, kind="stable")
                lo, hi = _runs(lo[o], hi[o] - 1 + length)
                if not len(lo):
                    continue
                if words:
                    lo, hi = first[lo], last[hi - 1]
                keep = np.zeros(len(raw) + 1, np.int32)
                np.add.at(keep, lo, 1)
                np.add.at(keep, hi, -1)
                kept = raw[np.cumsum(keep[:-1]) == 0].tobytes()
                spans = np.stack((lo, hi), 1)
                rows.append((key, len(raw) - len(kept), len(lo), hashlib.sha256(kept).hexdigest(), spans.tolist() if texts else None))
            kinds = [pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64()))]
            names = ["key", "n_removed", "n_spans", "kept_sha256", "spans"]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    return run


def repeated_bytes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 400, words: bool = False, spans: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256[, spans]) for every row of ``docs``.

    A byte goes when some string of ``length`` bytes that covers it starts anywhere
    else too, in the same text or another; strings overlap freely and are judged on
    the input. With ``words`` the strings are of ``length`` words, and go from their
    first word's first byte to their last word's last. ``spans`` adds the maximal removed byte ranges [from, to]. Null texts
    count as empty; empty and short texts lose nothing; repeated rows lose all they
    share, whatever their ids; ids may be null or repeated. Other columns are
    ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    prepare(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    sha = F.sha2(text.cast("binary"), 256)
    docs = docs.select(F.col(id_col).alias("id"), text.alias("text"), sha.alias("sha"), F.unhex(F.substring(sha, 1, 32)).alias("key"))
    light = settled(docs.select("id", "key", F.unhex("sha").alias("sha"), F.octet_length("text").cast("long").alias("n_bytes")), "texts")
    r, _ = geometry(length)
    total = (light.agg(F.sum("n_bytes")).first()[0] or 0) / (6 if words else 1)  # words are of about six bytes
    ranges = max(64, int(total * 2 / r / RANGE))
    least = 2 * length - 1 if words else length
    counted = light.groupBy("key").agg(F.count("*").alias("w"), F.first("n_bytes").alias("n_bytes"))
    copied = settled(counted.where(f"w > 1 and n_bytes >= {least}").select("key", F.lit(True).alias("copied")), "copied")
    bits = spark.sparkContext.broadcast(id_bits(copied.select(F.xxhash64("key").alias("h")), "h"))
    tried = docs.where(F.octet_length("text") >= least).select("key", "text").withColumn("tried", may_be_listed(F.xxhash64("key"), bits))
    one_each = settled(tried.where("tried").groupBy("key").agg(F.first("text").alias("text")), "copies")
    distinct = tried.where("not tried").drop("tried").unionByName(one_each)  # copies are one row from here on
    parsed = settled(distinct.mapInArrow(_shards(length, ranges, words), SHARDS), "shards")
    blocks = parsed.where("range is not null").select("shard", "range", "prefixes", "contexts", "twice")
    flags = settled(blocks.groupBy("range").applyInPandas(_interleave, "shard long, range long, flags binary"), "flags")
    release(spark)
    shards = parsed.where("range is null").select("shard", "keys", "owned", "windows", "offsets", "which")
    found = shards.groupBy("shard").cogroup(flags.groupBy("shard")).applyInPandas(_by_text, "key binary, sure binary, told binary")
    found = settled(found.join(copied, "key", "full"), "found")
    done_with(parsed, flags)
    bits = spark.sparkContext.broadcast(id_bits(found.select(F.xxhash64("key").alias("h")), "h"))
    some = distinct.select("key", "text", F.xxhash64("key").alias("h")).mapInArrow(_flagged(bits), "key binary, text string")
    open_texts = settled(some.join(found, "key"), "open")
    done_with(found, one_each, copied)
    windows = settled(open_texts.where(F.length("told") > 0).select("key", "text", "told").mapInArrow(_windows(length, ranges, words), WINDOWS), "windows")
    blocks = windows.where("range is not null").select("shard", "range", "hashes", "prefixes", "twice")
    flags = settled(blocks.groupBy("range").applyInPandas(_tell, "shard long, range long, flags binary"), "told")
    release(spark)
    open_windows = windows.where("range is null").select("shard", "keys", "texts", "starts", "which")
    starts = open_windows.groupBy("shard").cogroup(flags.groupBy("shard")).applyInPandas(_starts, "key binary, starts binary")
    starts = settled(starts, "starts")
    done_with(windows, flags)
    cut = open_texts.select("key", "text", "sure", "copied").join(starts, "key", "left").mapInArrow(
        _cut(length, words, spans), "key binary, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>"
    )
    cut = settled(cut.join(counted.select("key", "w"), "key"), "cut")
    done_with(open_texts, starts)
    out = attach(light, cut, "key", "w").select(
        F.col("id").alias(id_col),
        "n_bytes",
        F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
        F.coalesce("kept_sha256", F.lower(F.hex("sha"))).alias("kept_sha256"),
        *([F.col("key").alias("text_key"), F.col("spans")] if spans else []),
    )
    return out


def repeated_bytes_and_words(docs: DataFrame, *, length: int = 400, words: int = 51) -> DataFrame:
    """``repeated_bytes`` with n_word_bytes: the bytes that repeated strings of ``words`` words cover.

    A passage of short words repeats without reaching ``length`` bytes; n_word_bytes tells it. It
    counts from a string's first word to its last, overlaps once, and changes no other column.
    Null, empty and short texts have 0; repeated rows have the same.
    """
    spark = docs.sparkSession
    out = settled(repeated_bytes(docs, length=length, spans=True).drop("spans"), "bytes")
    release(spark)
    by_word = repeated_bytes(docs, length=words, words=True, spans=True).where("n_removed > 0")
    by_text = by_word.groupBy("text_key").agg(F.first("n_removed").alias("n_word_bytes"), F.count("*").alias("w"))
    told = attach(out, settled(by_text, "words"), "text_key", "w").drop("text_key")
    return told.withColumn("n_word_bytes", F.coalesce("n_word_bytes", F.lit(0)).cast("long"))


def text_key(text: Column) -> Column:
    """What ``repeated_bytes`` names a text by: half of its SHA-256."""
    return F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256), 1, 32))


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            raw, at, parts = (text or "").encode(), 0, []
            lo, hi = np.array(sorted(spans), np.int64).reshape(-1, 2).T
            for lo, hi in zip(*(x.tolist() for x in _runs(lo, hi)), strict=True):  # a character goes only as a whole
                while lo < hi and raw[lo] & 0xC0 == 0x80:
                    lo += 1
                while hi < len(raw) and hi > lo and raw[hi] & 0xC0 == 0x80:
                    hi -= 1
                parts.append(raw[at:lo])
                at = max(lo, hi)
            out.append(b"".join([*parts, raw[at:]]).decode())
        yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(out, pa.string())).drop_columns(["spans"])


def remove_repeats(docs: DataFrame, *, text_col: str = "text", length: int = 400, words: int | None = None) -> DataFrame:
    """``docs`` with the bytes that ``repeated_bytes`` finds taken out of their texts.

    With ``words``, repeated strings of so many words go too; both kinds are judged on
    the input. Characters of which only a part repeats stay. All rows and columns are
    kept, null texts too; only texts that lose something are shuffled.
    """
    spark = docs.sparkSession
    texts = docs.select(F.lit(0).alias("doc_id"), F.col(text_col).alias("text"))
    kinds = [(length, False), *([(words, True)] if words else [])]
    found = None
    for n, by_word in kinds:
        some = repeated_bytes(texts, length=n, words=by_word, spans=True).where("n_spans > 0")
        some = settled(some.groupBy("text_key").agg(F.first("spans").alias("spans")), "repeats")
        release(spark)
        found = some if found is None else found.unionByName(some)
    found = found.groupBy("text_key").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    bits = spark.sparkContext.broadcast(id_bits(found.select(F.xxhash64("text_key").alias("h")), "h"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(text_col).alias("text"), text_key(F.col(text_col)).alias("key"))
    rows = rows.withColumn("tried", may_be_listed(F.xxhash64("key"), bits))
    same = rows.where(~F.col("tried")).select("row", "text")
    hit = rows.where("tried").join(found.withColumnRenamed("text_key", "key"), "key", "left").select("row", "text", "spans")
    cut = hit.where("spans is not null")
    kind = same.schema
    out = same.unionByName(hit.where("spans is null").select("row", "text")).unionByName(cut.mapInArrow(_without, kind))
    return out.select(*(F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns))


def repeats_sql(length: int, words: int) -> str:
    """``repeated_bytes_and_words`` in DuckDB SQL, by the hash of every window."""
    return f"""
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
b as (select doc_id, h, unnest(range(1, cast(len(h) / 2 as bigint) + 1)) as i from d),
w as (select doc_id, i, substr(h, 2 * i - 1, 2) as byte, case when 2 * i - 1 + {2 * length} <= len(h) + 1 then md5_number(substr(h, 2 * i - 1, {2 * length})) end as k from b),
r as (select doc_id, i, byte, k is not null and count(*) over (partition by k) > 1 as again from w),
c as (select doc_id, i, byte, bool_or(again) over (partition by doc_id order by i rows between {length - 1} preceding and current row) as gone from r),
t as (select doc_id, i, byte, gone, gone and not coalesce(lag(gone) over (partition by doc_id order by i), false) as first_ from c),
a as (select doc_id, count(*) as n_bytes, count(*) filter (where gone) as n_removed, count(*) filter (where first_) as n_spans,
  sha256(unhex(coalesce(string_agg(byte, '' order by i) filter (where not gone), ''))) as kept_sha256 from t group by 1),
p as (select doc_id, regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+') as pieces from documents),
q as (select doc_id, pieces, list_transform(pieces, lambda x: regexp_replace(x, '^[\\x20\\x09-\\x0D]+', '')) as words from p),
v as (select doc_id, words, pieces, unnest(range(1, len(words) + 1)) as i from q),
x as (select doc_id, i, strlen(words[i]) as word, strlen(pieces[i]) as piece,
  case when i + {words - 1} <= len(words) then md5_number(array_to_string(list_slice(words, i, i + {words - 1}), ' ')) end as k from v),
y as (select doc_id, i, word, piece, k is not null and count(*) over (partition by k) > 1 as again from x),
z as (select doc_id, i, word, piece, bool_or(again) over (partition by doc_id order by i rows between {words - 1} preceding and current row) as gone from y),
g as (select doc_id, gone, case when lag(gone) over (partition by doc_id order by i) then piece else word end as n from z),
n as (select doc_id, sum(n) filter (where gone) as n_word_bytes from g group by 1)
select d.doc_id, coalesce(n_bytes, 0) as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans,
  coalesce(kept_sha256, sha256('')) as kept_sha256, cast(coalesce(n_word_bytes, 0) as bigint) as n_word_bytes
from d left join a using (doc_id) left join n using (doc_id)"""
