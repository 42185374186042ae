"""N-gram Jaccard join by a token-group matrix.

Texts are sets of hashed word shingles; two texts link when their sets' Jaccard
similarity reaches a threshold, tested exactly on whole sets. Candidates come from
shared *rare* shingles: in one order of all shingles, rarest first, two linked sets
share a shingle among the first ``n - ceil(t n) + 1`` of each, whatever the order
is. Texts whose most frequent such shingle is the same form a group (large ones are
split into parts). A group is a matrix of its members by the union of their
shingles, and links inside it are read off the matrix. A text of another group that
shares a rare shingle is held against the group as a whole: if it has too few
shingles in common with the union, no member can link and the group stays closed;
only qualifying groups are opened. Since the result is the components, a text is
only held against groups with a larger component than its own, and links are
returned as pairs of components. So near copies of any number cost texts times
groups, not pairs. Texts with equal sets are one node throughout.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyframe.llm import texthash
from surveyframe.llm.common import attach, components, id_bits, keep_bits, may_be_listed, prepare, release, settled, slabs, split_by_bits, tidy, total_of

#: Counters of the frequency sketch: 32 MB of them whatever the corpus.
SKETCH_BITS = 23
SLICES = 16
#: Members of a group, on average; four times as many texts are held against one copy of it.
GROUP = 256
#: Postings that one group of tasks sorts together, and that a task holds before it passes them on.
RANGE = 200_000
#: Partners by size that a posting is held against before it is kept untried.
TRIED = 40
FLUSH = 500_000


def _node(tokens: np.ndarray) -> np.int64:
    """64-bit fingerprint of a set; among n sets about n*n/2**65 false matches are expected."""
    total = np.add.reduce(texthash.mix(tokens ^ np.uint64(0x5851F42D4C957F2D)))
    return texthash.mix(np.array([total], np.uint64) + np.uint64(len(tokens)))[:1].view(np.int64)[0]


def _signatures(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, kind = np.zeros(1 << SKETCH_BITS, np.uint32), pa.int64()
        names = ["id", "node", "n", "slice", "counts"]
        for batch in batches:
            kind = batch.schema.field("id").type
            nodes, counts = [], []
            for _, _, buf, bounds in slabs(batch, limit=1 << 20):
                sets = texthash.shingles(buf, bounds, size)
                for t in sets:
                    nodes.append(_node(t) if len(t) else None)
                    counts.append(len(t))
                at, more = np.unique(np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS), return_counts=True)
                sketch[at] += more.astype(np.uint32)
            n = len(nodes)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(nodes, pa.int64()), pa.array(counts, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())],
                names=names,
            )
        if sketch.any():
            none = pa.nulls(SLICES, pa.int64())
            small = np.uint8 if sketch.max() < 1 << 8 else np.uint16 if sketch.max() < 1 << 16 else np.uint32
            parts = [x.astype(small).tobytes() for x in np.split(sketch, SLICES)]
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(SLICES, kind), none, none, pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary())], names=names
            )
            del parts
        del sketch
        tidy()

    return run


def _add_counts(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """The sums of a slice, up to 2**16 - 1, compressed: the driver holds all slices at once."""
    total = np.zeros((1 << SKETCH_BITS) // SLICES, np.int64)
    for x in rows["counts"]:
        total += np.frombuffer(x, {1: np.uint8, 2: np.uint16, 4: np.uint32}[len(x) // len(total)])
    return pd.DataFrame({"slice": [key[0]], "counts": [zlib.compress(np.minimum(total, 2**16 - 1).astype(np.uint16).tobytes(), 1)]})


def _prefixes(size: int, percent: int, ranges: int, sketch):
    """(range, tokens, nodes, sizes, places) with the rare shingles of each set, packed by ranges of hash values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, seen, held, count = sketch.value, set(), [], 0

        def packed():
            t, nodes, sizes, places = (np.concatenate(x) for x in zip(*held, strict=True))
            at = np.minimum((t >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32), np.uint64(ranges - 1)).astype(np.int64)
            o = np.argsort(at, kind="stable")
            t, nodes, sizes, places, at = t[o], nodes[o], sizes[o], places[o], at[o]
            cut = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
            ends = [*cut[1:].tolist(), len(at)]
            spans = list(zip(cut.tolist(), ends, strict=True))
            return pa.RecordBatch.from_arrays(
                [pa.array(at[cut], pa.int64()), *(pa.array([x[a:b].tobytes() for a, b in spans], pa.binary()) for x in (t, nodes, sizes, places))],
                names=["range", "tokens", "nodes", "sizes", "places"],
            )

        for batch in batches:
            for _, _, buf, bounds in slabs(batch, limit=1 << 20):
                for t in texthash.shingles(buf, bounds, size):
                    m = len(t)
                    if not m or (node := _node(t)) in seen:
                        continue
                    seen.add(node)
                    f = order[(t >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                    k = m - -(-percent * m // 100) + 1
                    first = t[np.lexsort((t, f))[:k]]
                    held.append((first, np.full(k, node), np.full(k, m, np.int32), np.arange(k, dtype=np.int32)))
                    count += k
                if count > FLUSH:
                    yield packed()
                    held, count, seen = [], 0, set()
        if held:
            yield packed()
        del held, seen
        tidy()

    return run


def needed(n, m, percent: int):
    """Shingles that two linked sets of n and m have in common at least."""
    return -(-percent * (n + m) // (100 + percent))


def _shared(percent: int):
    """Postings whose shingle another set holds that, by both sizes and places, may link.

    All shingles before the first common one are different ones, so what is left from
    there on, in either set, bounds the intersection.
    """

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        tidy()  # what the last group left
        kinds = (("tokens", np.uint64), ("nodes", np.int64), ("sizes", np.int32), ("places", np.int32))
        t, node, n, place = (np.concatenate([np.frombuffer(x, kind) for x in rows[c]]) for c, kind in kinds)
        o = np.lexsort((node, n, t))
        t, node, n, place = t[o], node[o], n[o].astype(np.int64), place[o]
        new = np.concatenate(([True], (t[1:] != t[:-1]) | (node[1:] != node[:-1])))
        t, node, n, left = t[new], node[new], n[new], (n - place)[new]
        keep, step = np.zeros(len(t), bool), 1
        near = np.ones(len(t), bool)  # rows whose partner, so many rows on, may still be near enough in size
        while step < min(len(t), TRIED):
            a = np.flatnonzero(near[:-step] & (t[step:] == t[:-step]))
            a = a[n[a] * 100 >= n[a + step] * percent]
            if not len(a):
                break
            near[:] = False
            near[a] = True
            ok = a[np.minimum(left[a], left[a + step]) >= needed(n[a], n[a + step], percent)]
            keep[ok] = keep[ok + step] = True
            step += 1
        else:
            many = np.flatnonzero(near[:-step] & (t[step:] == t[:-step])) if step < len(t) else []
            keep |= np.isin(t, t[many])  # a shingle of very many sets keeps all its postings
        return pd.DataFrame({"token": t[keep].view(np.int64), "node": node[keep], "n": n[keep], "remain": left[keep]})

    return run


def _sets(size: int, wanted):
    """(node, tokens) of the sets whose node may be wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            nodes, tokens = [], []
            for _, _, buf, bounds in slabs(batch, limit=1 << 20):
                for t in texthash.shingles(buf, bounds, size):
                    if len(t) and (node := _node(t)) not in seen and keep_bits(np.array([node]), wanted.value)[0]:
                        seen.add(node)
                        nodes.append(node)
                        tokens.append(t.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(tokens, pa.binary())], names=["node", "tokens"])

    return run


class Matrix:
    """A group's sets as a matrix: for each shingle of the group's union, the members that hold it."""

    def __init__(self, tokens: list[np.ndarray]):
        self.size = np.array([len(t) for t in tokens], np.int64)
        every = np.concatenate(tokens)
        member = np.repeat(np.arange(len(tokens)), self.size)
        order = np.argsort(every, kind="stable")
        self.member = member[order]
        self.union, first = np.unique(every[order], return_index=True)
        self.ends = np.append(first, len(every))

    def common(self, tokens: np.ndarray, least: int) -> np.ndarray | None:
        """Shingles in common with each member, or None if too few are in the union for any."""
        at = np.searchsorted(self.union, tokens)
        at[at == len(self.union)] = 0
        at = at[self.union[at] == tokens]
        if len(at) < least:
            return None  # the group stays closed
        count = self.ends[at + 1] - self.ends[at]
        i = np.repeat(self.ends[at] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
        return np.bincount(self.member[i], minlength=len(self.size))

    def linked(self, tokens: np.ndarray, percent: int) -> np.ndarray:
        """The members that a set links with."""
        least = int(needed(len(tokens), self.size.min(), percent))
        both = self.common(tokens, least)
        if both is None:
            return np.zeros(0, np.int64)
        return np.flatnonzero(100 * both >= percent * (self.size + len(tokens) - both))


def _within(percent: int):
    """Components of the links inside each group: (node, label, size), the label being the smallest node."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        tidy()
        rows = rows.sort_values("node", ignore_index=True)
        sets = [np.frombuffer(x, np.uint64) for x in rows["tokens"]]
        matrix, label = Matrix(sets), np.arange(len(rows))
        for i, t in enumerate(sets):
            own = label[matrix.linked(t, percent)]
            if len(own):
                label[np.isin(label, own)] = min(own.min(), label[i])
        nodes = rows["node"].to_numpy()
        return pd.DataFrame({"node": nodes, "label": nodes[label], "size": np.bincount(label, minlength=len(label))[label]})

    return run


def _open_groups(percent: int):
    """Links between components: texts x against the members of other groups that are in larger components."""

    def run(key: tuple, texts: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        links = set()
        tidy()
        if len(texts) and len(members):
            matrix = Matrix([np.frombuffer(x, np.uint64) for x in members["tokens"]])
            size, label = members["size"].to_numpy(), members["label"].to_numpy()
            for own, own_size, raw in zip(texts["x_label"], texts["x_size"], texts["x_tokens"], strict=True):
                found = matrix.linked(np.frombuffer(raw, np.uint64), percent)
                found = found[(size[found] > own_size) | (size[found] == own_size) & (label[found] > own)]
                links |= {(own, x) for x in label[found].tolist()}
        return pd.DataFrame(sorted(links), columns=["a", "b"]).astype("int64")

    return run


def _grouped(shared: DataFrame) -> DataFrame:
    """(node, g, alone): texts whose most frequent rare shingle is the same, ``GROUP`` to a group."""
    frequent = shared.groupBy("token").agg(F.count("*").alias("df"))
    top = shared.join(frequent, "token").groupBy("node").agg(F.max(F.struct("df", "token")).alias("top"))
    placed = settled(top.select("node", F.col("top.token").alias("top")), "top")
    sizes = placed.groupBy("top").agg(F.count("*").alias("size"))
    part = F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / GROUP))
    return settled(placed.join(sizes, "top").select("node", F.xxhash64("top", part).alias("g"), (F.col("size") == 1).alias("alone")), "groups")


def _across(shared: DataFrame, placed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links of components in different groups, as pairs of labels.

    ``placed`` has (node, g, label, size), ``sets`` (node, g, tokens). For two
    components the smaller one's texts are held against the larger one's groups, if any
    rare shingle is shared. A group that many texts name is copied once for every
    ``GROUP`` * 4 of them.
    """
    spark = shared.sparkSession
    rows = settled(shared.join(placed, "node"), "placed")
    groups = rows.groupBy("token", "g").agg(
        F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("remain").alias("g_remain"), F.max(F.struct("size", "label")).alias("largest")
    )
    texts = rows.select("token", F.col("node").alias("x"), "n", "remain", F.col("label").alias("x_label"), F.col("size").alias("x_size"), F.col("g").alias("x_g"))
    pairs = (
        texts.join(groups, "token")
        .where("g <> x_g")
        .where("largest.size > x_size or largest.size = x_size and largest.label > x_label")
        .where(f"lo * {percent} <= n * 100 and n * {percent} <= hi * 100")
        .where(f"least(remain, g_remain) * {100 + percent} >= (n + lo) * {percent}")
        .select("g", "x", "x_label", "x_size")
        .distinct()
    )
    pairs = settled(pairs, "pairs")
    copies = pairs.groupBy("g").agg(F.ceil(F.count("*") / (GROUP * 4)).cast("int").alias("copies"))
    asked = spark.sparkContext.broadcast(id_bits(pairs.select("x").distinct(), "x"))
    named = spark.sparkContext.broadcast(id_bits(copies, "g"))
    key = ["g", "copy"]
    spread = pairs.join(copies, "g").withColumn("copy", F.pmod(F.xxhash64("x"), F.col("copies")).cast("int")).drop("copies")
    own = split_by_bits(sets.select("node", "tokens"), "node", asked, True)
    left = spread.join(own.select(F.col("node").alias("x"), F.col("tokens").alias("x_tokens")), "x")
    members = split_by_bits(sets, "g", named, True).join(placed.select("node", "label", "size"), "node")
    right = members.join(copies, "g").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    right = right.select(*(F.col(c).alias(c) for c in (*key, "label", "size", "tokens")))
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(_open_groups(percent), "a long, b long")


def jaccard_join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id) for every row of ``docs``.

    Words are runs without ASCII white space, ASCII letters lower-cased; a text's
    set holds its distinct shingles of ``size`` words, or with fewer words all of
    them as one. Rows link when ``100 * intersection >= percent * union``;
    ``component_id`` is the smallest id reachable by links, the row's own included.
    Null, empty and blank texts have the empty set and link with nothing, their own
    copies included. A row with a null id takes part, and its component is null if no
    member has an id. Repeated rows and ids are kept; other columns are ignored. An
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    out = settled(docs.mapInArrow(_signatures(size), f"id {kind}, node long, n long, slice int, counts binary"), "sets")
    rows = out.where("slice is null").select("id", "node", "n")
    # one row per set: its smallest id and its copies
    nodes = settled(rows.where("node is not null").groupBy("node").agg(F.min("id").alias("least"), F.count("*").alias("copies"), F.first("n").alias("n")), "nodes")
    sketch = np.zeros(1 << SKETCH_BITS, np.uint16)
    for x in out.where("slice is not null").groupBy("slice").applyInPandas(_add_counts, "slice int, counts binary").collect():  # 16 MB at most
        step = len(sketch) // SLICES
        sketch[x.slice * step : (x.slice + 1) * step] = np.frombuffer(zlib.decompress(x.counts), np.uint16)
    ranges = max(64, (total_of(nodes, "n") * (100 - percent) // 100) // RANGE)
    order = spark.sparkContext.broadcast(sketch)
    del sketch
    postings = docs.select("text").mapInArrow(_prefixes(size, percent, ranges, order), "range long, tokens binary, nodes binary, sizes binary, places binary")
    shared = settled(postings.groupBy("range").applyInPandas(_shared(percent), "token long, node long, n long, remain long"), "shared")
    placed = _grouped(shared)
    bits = spark.sparkContext.broadcast(id_bits(placed, "node"))
    found = docs.select("text").mapInArrow(_sets(size, bits), "node long, tokens binary")
    sets = settled(found.join(placed, "node").groupBy("node", "g", "alone").agg(F.first("tokens").alias("tokens")), "tokens")
    release(spark)
    inside = sets.where("not alone").groupBy("g").applyInPandas(_within(percent), "node long, label long, size long")
    alone = sets.where("alone").select("node", F.col("node").alias("label"), F.lit(1).cast("long").alias("size"))
    local = inside.unionByName(alone).select(F.col("node").alias("x"), "label", "size")
    placed = settled(placed.drop("alone").join(local, F.col("node") == F.col("x")).drop("x"), "labels")
    release(spark)
    sets = sets.drop("alone")
    root = components(settled(_across(shared, placed, sets, percent), "links")).select(F.col("node").alias("label"), F.col("label").alias("root"))
    component = placed.select("node", "label").join(root, "label", "left").select("node", F.coalesce("root", "label").alias("label"))
    labelled = nodes.join(component, "node", "left").withColumn("label", F.coalesce("label", "node"))
    labelled = settled(labelled, "labels")
    release(spark)
    least = labelled.groupBy("label").agg(F.min("least").alias("component_id"), F.count("*").alias("w"))
    of_node = attach(labelled.select("node", "label", "copies"), least, "label", "w").select("node", "component_id", "copies")
    done = attach(rows.where("node is not null"), of_node, "node", "copies")
    alone = rows.where("node is null").withColumn("component_id", F.col("id"))
    return done.unionByName(alone).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without those that ``jaccard_join`` links with a smaller id.

    Rows without an id stay, as do repeated rows of the id that stays. Only rows whose
    id may be one that goes are shuffled.
    """
    spark = docs.sparkSession
    joined = jaccard_join(docs, id_col=id_col, text_col=text_col, size=size, percent=percent)
    goes = settled(joined.where(F.col(id_col) > F.col("component_id")).select(F.col(id_col).alias("goes")).distinct(), "goes")
    release(spark)
    bits = spark.sparkContext.broadcast(id_bits(goes.select(F.xxhash64("goes").alias("h")), "h"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("goes"))
    rows = rows.withColumn("tried", may_be_listed(F.xxhash64("goes"), bits))
    stay = rows.where(~F.col("tried")).select("row").unionByName(rows.where("tried").join(goes, "goes", "left_anti").select("row"))
    return stay.select("row.*")


def jaccard_sql(size: int, percent: int) -> str:
    """The same in DuckDB SQL, by comparing all texts that share a shingle."""
    return f"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) >= {size} then [array_to_string(w[i:i + {size - 1}], ' ') for i in range(1, len(w) - {size - 2})]
  when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g from d),
n as (select doc_id, count(*) as n from s group by 1),
p as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b using (g) where a.doc_id < b.doc_id group by 1, 2),
l as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= {percent} * (a.n + b.n - c)),
both_ as (select x, y from l union all select y, x from l),
reach as (select doc_id as x, doc_id as y from d union select r.x, b.y from reach r join both_ b on b.x = r.y)
select d.doc_id, coalesce(n, 0) as n_shingles, c.component_id from d left join n using (doc_id)
join (select x as doc_id, min(y) as component_id from reach group by 1) c using (doc_id)"""
