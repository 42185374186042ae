"""The trie of conversation prefixes, its subtree totals by parallel tree contraction.

A prefix is told by the exclusive-or of 128-bit hashes of its turns with their
positions, so that prefixes follow from running aggregates over blocks of a
conversation, however long it is. Each distinct prefix is a node.

Subtree totals come from contracting the tree in rounds of joins. A round rakes all
leaves: a leaf's total is known, and is added to its parent. Then it compresses chains:
a node with one child, under a parent with one child, is absorbed by that parent, and a
depth bit that changes from round to round picks which, so that no two neighbours go at
once and a chain is halved each time. Each round is a table. Afterwards the rounds are
expanded in reverse: the total of an absorbed node is what it held when it went, plus
the total of its only child, which left later.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surveyframe.llm.common import attach, prepare, release, settled

#: Rows of a conversation, or ends of a node, that are numbered or written together.
BLOCK_ROWS = 100_000
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of ids that one row of ends holds.
CHUNK = 1 << 16


def _blocks(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """``df`` in order of ``by`` over range partitions of some BLOCK_ROWS rows, with the partition as ``block``."""
    n = max(1, -(-df.count() // BLOCK_ROWS))
    return settled(df.repartitionByRange(n, *by).withColumn("block", F.spark_partition_id()), name)


def turns_of(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, at, role, text): each conversation's turns from place 0, in order of turn (null first), role and text.

    Rows are numbered within blocks of an order over the whole table, and the blocks of a
    conversation are added up, so that no task receives a whole conversation.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), text(role_col).alias("role"), text(text_col).alias("text")
    )
    rows = _blocks(rows, ["conv", "turn", "role", "text"], "turns")
    sizes = rows.groupBy("conv", "block").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("conv").orderBy("block")
    skips = sizes.withColumn("skip", F.sum("n").over(earlier) - F.col("n")).select("conv", "block", "skip")
    own = Window.partitionBy("conv", "block").orderBy(F.asc_nulls_first("turn"), "role", "text")
    ranked = rows.withColumn("rank", F.row_number().over(own) - 1)
    return ranked.join(skips, ["conv", "block"]).select("conv", (F.col("rank") + F.col("skip")).alias("at"), "role", "text")


def rebuilt(turns: DataFrame, every: int, heads: int) -> tuple[DataFrame, DataFrame]:
    """The conversations (conv, head, of) and their turns (conv, depth, role, text) after rebuilding."""
    head = F.crc32(F.col("conv").cast("string")) % heads
    convs = turns.select("conv").distinct().select("conv", head.alias("head"), (F.col("conv") - F.col("conv") % every).alias("of"))
    convs = settled(convs, "conversations")
    lead = turns.where(F.col("at") < heads).select(F.col("conv").alias("of"), "at", "role", "text")
    first = convs.join(lead, "of").where(F.col("at") < F.col("head")).select("conv", (F.col("at") + 1).alias("depth"), "role", "text")
    given = lead.groupBy("of").agg(F.count("*").alias("given"))
    shift = convs.join(given, "of", "left").select("conv", "head", F.least("head", F.coalesce("given", F.lit(0))).alias("taken"))
    rest = turns.join(shift, "conv").where(F.col("at") >= F.col("head"))
    rest = rest.select("conv", (F.col("at") - F.col("head") + F.col("taken") + 1).alias("depth"), "role", "text")
    return convs, first.unionByName(rest)


def _told(turns: DataFrame) -> DataFrame:
    """(conv, depth, words, x, y, px, py): the prefix that ends with each turn, and the one before it."""
    turn = [F.col("depth"), F.col("role"), F.col("text")]
    words = F.size(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    rows = turns.select("conv", "depth", words.alias("words"), F.xxhash64(F.lit(1), *turn).alias("hx"), F.xxhash64(F.lit(2), *turn[::-1]).alias("hy"))
    rows = _blocks(rows, ["conv", "depth"], "hashes")
    sums = rows.groupBy("conv", "block").agg(F.bit_xor("hx").alias("bx"), F.bit_xor("hy").alias("by"))
    earlier = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("conv", "block", *(F.coalesce(F.bit_xor(c).over(earlier), F.lit(0).cast("long")).alias(c) for c in ("bx", "by")))
    so_far = Window.partitionBy("conv", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"x": F.bit_xor("hx").over(so_far), "y": F.bit_xor("hy").over(so_far)}).join(before, ["conv", "block"])
    x, y = F.col("x").bitwiseXOR(F.col("bx")), F.col("y").bitwiseXOR(F.col("by"))
    told = rows.select("conv", "depth", "words", x.alias("x"), y.alias("y"), "hx", "hy")
    return told.withColumns({"px": F.col("x").bitwiseXOR(F.col("hx")), "py": F.col("y").bitwiseXOR(F.col("hy"))}).drop("hx", "hy")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv, depth, id) in order: the ids of a node joined by commas, in pieces of some CHUNK bytes."""

    def row(node, first, ids):
        return {"conv": [node[0]], "depth": [node[1]], "first": [first], "ids": [",".join(map(str, ids))]}

    schema = pa.schema([("conv", pa.int64()), ("depth", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])
    node, ids, size = None, [], 0
    for batch in batches:
        for c, d, i in zip(*(batch.column(k).to_pylist() for k in ("conv", "depth", "id")), strict=True):
            if ids and ((c, d) != node or size > CHUNK):
                yield pa.RecordBatch.from_pydict(row(node, ids[0], ids), schema)
                ids, size = [], 0
            node = (c, d)
            ids.append(i)
            size += len(str(i)) + 1
    if ids:
        yield pa.RecordBatch.from_pydict(row(node, ids[0], ids), schema)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of nodes in order: a digest of each node's ids, holding one piece at a time."""

    schema = pa.schema([("conv", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string())])
    node, digest = None, None
    for batch in batches:
        out = []
        for c, d, ids in zip(*(batch.column(k).to_pylist() for k in ("conv", "depth", "ids")), strict=True):
            if (c, d) == node:
                digest.update(b",")
            else:
                if node:
                    out.append((*node, digest.hexdigest()))
                node, digest = (c, d), hashlib.sha256()
            digest.update(ids.encode())
        if out:
            yield pa.RecordBatch.from_pydict(dict(zip(schema.names, map(list, zip(*out, strict=True)), strict=True)), schema)
    if node:
        yield pa.RecordBatch.from_pydict(dict(zip(schema.names, ([node[0]], [node[1]], [digest.hexdigest()]), strict=True)), schema)


def _ends(ends: DataFrame) -> DataFrame:
    """(conv, depth, ends_sha256) of nodes (conv, depth) in which ids (id) end.

    The ids are sorted and written out over ranges of all ends; only the joined pieces of
    a node meet in one task, one after another, since a digest can't be parted.
    """
    order = ["conv", "depth", "id"]
    n = max(1, -(-ends.count() // BLOCK_ROWS))
    pieces = ends.select(*order).repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(_chunks, "conv long, depth long, first long, ids string")
    dealt = settled(pieces, "ends").repartition("conv", "depth").sortWithinPartitions("conv", "depth", "first")
    return dealt.mapInArrow(_digests, "conv long, depth long, ends_sha256 string")


ID, PARENT = ["conv", "depth"], ["up_conv", "up_depth"]


def _by_parent(df: DataFrame, *sums: Column) -> DataFrame:
    """Sums over the children of each node, keyed by the node."""
    return df.where("up_conv is not null").groupBy(F.col("up_conv").alias("conv"), F.col("up_depth").alias("depth")).agg(*sums)


def subtree_sums(nodes: DataFrame, sums: list[str]) -> DataFrame:
    """(conv, depth, *sums) with each sum over the node's whole subtree.

    ``nodes`` are (conv, depth, up_conv, up_depth, *sums): a tree with a null parent at its
    root, every child one or more deeper than its parent.
    """
    active = settled(nodes.select(*ID, *PARENT, *sums), "tree")
    bits = max(1, (active.agg(F.max("depth")).first()[0] or 0).bit_length())
    raked, absorbed, turn = [], [], 0
    add = lambda c: (F.col(c) + F.coalesce(F.col(f"_{c}"), F.lit(0))).alias(c)
    while True:
        kids = _by_parent(active, F.count("*").alias("kids"))
        told = settled(active.join(kids, ID, "left").withColumn("kids", F.coalesce("kids", F.lit(0))), "tree")
        leaves = told.where("kids = 0").select(*ID, *sums)
        raked.append(leaves)
        given = _by_parent(told.where("kids = 0"), F.count("*").alias("gone"), *(F.sum(c).alias(f"_{c}") for c in sums))
        left = told.where("kids > 0").join(given, ID, "left")
        left = settled(left.select(*ID, *PARENT, (F.col("kids") - F.coalesce("gone", F.lit(0))).alias("kids"), *(add(c) for c in sums)), "tree")
        if left.isEmpty():
            break
        # a picked node and the parent that absorbs it: both have one child, and the bit differs
        bit = F.shiftright("depth", turn % bits).bitwiseAND(F.lit(1))
        single = left.where("kids = 1")
        goes = single.where(bit == 1).join(single.where(bit == 0).select(F.col("conv").alias("up_conv"), F.col("depth").alias("up_depth")), PARENT, "left_semi")
        goes = settled(goes.select(*ID, *PARENT, *sums), "absorbed")
        if not goes.isEmpty():
            # its only child: what is left under it
            under = left.select(F.col("conv").alias("low_conv"), F.col("depth").alias("low_depth"), F.col("up_conv").alias("conv"), F.col("up_depth").alias("depth"))
            goes = settled(goes.join(under, ID), "absorbed")
            absorbed.append((len(raked), goes))
            gained = _by_parent(goes, *(F.first(c).alias(f"_{c}") for c in sums))
            moved = goes.select(F.col("low_conv").alias("conv"), F.col("low_depth").alias("depth"), *(F.col(c).alias(f"new_{c}") for c in PARENT))
            stay = left.join(goes.select(*ID), ID, "left_anti").join(gained, ID, "left").join(moved, ID, "left")
            left = stay.select(*ID, *(F.coalesce(f"new_{c}", c).alias(c) for c in PARENT), *(add(c) for c in sums))
        active, turn = left.select(*ID, *PARENT, *sums), turn + 1
        release(nodes.sparkSession)

    # in reverse: what left after round r holds the children of all that was absorbed in it
    known, last = None, len(raked)
    for r, goes in reversed(absorbed):
        later = raked[r:last]
        known = reduce(DataFrame.unionByName, later if known is None else [known, *later])
        low = known.select(F.col("conv").alias("low_conv"), F.col("depth").alias("low_depth"), *(F.col(c).alias(f"_{c}") for c in sums))
        whole = goes.join(low, ["low_conv", "low_depth"]).select(*ID, *(add(c) for c in sums))
        known, last = known.unionByName(settled(whole, "expanded")), r
    return reduce(DataFrame.unionByName, raked[:last] if known is None else [known, *raked[:last]])


def prefix_trie(
    conversations: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", every: int = 20, heads: int = 4
) -> DataFrame:
    """One row for each distinct prefix of the rebuilt conversations, the empty one included.

    A conversation c begins with the first h turns of conversation ``c - c % every``
    (all, if it has fewer; none, if there is no such conversation), h being the crc32 of
    its decimal id modulo ``heads``; its own turns after its first h follow. Columns:
    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256, where members are the conversations that begin with the
    prefix, and saved tokens are (members - 1) times the words of the last turn, summed
    over the subtree.

    Turns are ordered by turn, nulls first, then by role and text, so that ties and
    repeated rows have one order; each repeated row is a turn. Null roles and texts are
    empty. Rows without a conversation are left out; extra columns are ignored. An empty
    table has no conversations and gives an empty result.
    """
    spark = conversations.sparkSession
    prepare(spark)
    turns = settled(turns_of(conversations, conv_col, turn_col, role_col, text_col), "turns")
    convs, rows = rebuilt(turns, every, heads)
    told = settled(_told(rows), "prefixes")
    release(spark)

    # nodes are known by their smallest member and depth from here on
    key = ["depth", "x", "y"]
    nodes = told.groupBy(*key).agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs"), F.first("words").alias("words"), F.first("px").alias("px"), F.first("py").alias("py"))
    nodes = settled(nodes, "nodes")
    zero = F.lit(0).cast("long")
    root = convs.agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select("conv", "n_convs", F.lit(0).alias("words"), zero.alias("depth"), F.struct(zero.alias("d"), zero.alias("x"), zero.alias("y")).alias("key"))
    own = nodes.select("conv", "n_convs", "words", "depth", F.struct(F.col("depth").alias("d"), "x", "y").alias("key")).unionByName(root)
    up = nodes.select("conv", "depth", F.struct((F.col("depth") - 1).alias("d"), F.col("px").alias("x"), F.col("py").alias("y")).alias("up"))
    kids = up.groupBy(F.col("up").alias("key")).agg(F.count("*").alias("n_children"))
    own = settled(own.join(kids, "key", "left").withColumn("n_children", F.coalesce("n_children", zero)), "nodes")
    parents = own.where("n_children > 0").select(F.col("key").alias("up"), F.col("conv").alias("up_conv"), F.col("depth").alias("up_depth"), "n_children")
    edges = settled(attach(up, parents, "up", "n_children").drop("up"), "edges")
    saved = (F.col("n_convs") - 1) * F.col("words")
    tree = own.join(edges, ID, "left").select(
        *ID, *PARENT, F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"), saved.alias("saved_tokens"), "n_convs", "n_children"
    )
    tree = settled(tree, "tree")

    # where conversations end: the deepest prefix of each, or the root
    deepest = told.groupBy("conv").agg(F.max(F.struct("depth", "x", "y")).alias("last"))
    last = convs.join(deepest, "conv", "left").select(
        F.col("conv").alias("id"),
        F.struct(*(F.coalesce(f"last.{c}", zero).alias(n) for c, n in (("depth", "d"), ("x", "x"), ("y", "y")))).alias("key"),
    )
    ends = settled(attach(last, own.select("key", *ID, "n_convs"), "key", "n_convs").drop("key"), "ends")

    totals = subtree_sums(tree, ["n_leaves", "saved_tokens"])
    out = tree.drop("n_leaves", "saved_tokens").join(totals, ID).join(_ends(ends), ID, "left")
    none = hashlib.sha256().hexdigest()
    return out.select(
        F.col("conv").alias("conv_id"),
        F.col("depth").cast("long").alias("depth"),
        F.col("up_conv").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"),
    )


def _crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII string, bit by bit."""
    bit = "lambda r, i: xor(r >> 1, 3988292384 * (r & 1))"
    byte = f"lambda c, b: list_reduce(list_prepend(xor(c, b), [cast(0 as bigint) for _ in range(8)]), {bit})"
    return f"xor(list_reduce(list_prepend(cast(4294967295 as bigint), [cast(ord(x) as bigint) for x in string_split({text}, '')]), {byte}), 4294967295)"


TRIE_SQL = f"""
with t as (select conv_id as c, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) - 1 as p,
  struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) as x from conversations where conv_id is not null),
h as (select c, c - c % 20 as s, {_crc32_sql("cast(c as varchar)")} % 4 as h from (select distinct c from t)),
own as (select c, list(x order by p) as xs from t group by c),
r as (select h.c, list_concat(coalesce(s.xs[:h.h], []), o.xs[h.h + 1:]) as xs from h join own o using (c) left join own s on s.c = h.s),
m as (select c, unnest(range(0, len(xs) + 1)) as d, xs from r),
n as (select min(c) as conv_id, d, xs[:d] as xs, count(*) as n_convs,
  string_agg(case when len(xs) = d then cast(c as varchar) end, ',' order by c) as ends from m group by d, xs[:d]),
w as (select *, case when d = 0 then 0 else (n_convs - 1) * len(regexp_extract_all(xs[d].text, '[^\\x20\\x09-\\x0D]+')) end as saved from n),
e as (select a.conv_id, a.d, p.conv_id as parent from w a left join w p on p.d = a.d - 1 and p.xs = a.xs[:a.d - 1]),
k as (select parent, d - 1 as d, count(*) as n_children from e where parent is not null group by all),
f as (select w.*, e.parent, coalesce(k.n_children, 0) as n_children from w join e using (conv_id, d) left join k on k.parent = w.conv_id and k.d = w.d)
select a.conv_id, a.d as depth, a.parent as parent_conv_id, a.n_convs, a.n_children, cast(count(*) filter (where b.n_children = 0) as bigint) as n_leaves,
  cast(sum(b.saved) as bigint) as saved_tokens, sha256(coalesce(a.ends, '')) as ends_sha256
from f a join f b on b.d >= a.d and b.xs[:a.d] = a.xs group by a.conv_id, a.d, a.parent, a.n_convs, a.n_children, a.ends"""
