"""Approximate nearest neighbours by inner product: NN-descent and greedy graph search.

A vector is its direction and its length. One half of a vector's neighbours are those
of nearest direction, so that the graph can be walked; the other half are, of the
rest, those of largest inner product with it, so that long vectors at a moderate
angle are met. With equal lengths both are one order. Queries score by the inner
product, length included, and begin at their own place and at the longest vectors.
Vectors are dealt to parts of about ``PART`` by a hash of their id, and everything
that moves is packed by part.

Equal vectors are one node, named by their smallest id; searching is for nodes, and
each stands for its smallest ids at the end.

Building: each vector starts with its best neighbours within its part. Then, round
by round, every vector introduces its neighbours (forward and reverse) to each
other: neighbours of neighbours are joined, and those better than what a vector has
replace its worst ones. Pairs that have met before are left out. The rounds end when
few neighbours change.

Searching: a query keeps a beam of the best vectors met, asks the parts of the best
ones not yet opened for their neighbours with scores, and ends when its beam holds
none unopened. All vectors are indexed, and none is fitted on a sample; the beam
is scored on the original vectors in double precision at the end.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from surveyframe.llm.common import attach, prepare, release, settled, tidy
from surveyframe.llm.texthash import U, mix
from surveyframe.llm.topk import valid

#: Vectors of a part, on average.
PART = 2_048
#: Neighbours of a vector in the graph, and reverse neighbours that join them in a round.
DEGREE = 32
#: Pairs that a part adds before it keeps only each vector's best.
HELD = 1_000_000
REVERSE = 32
#: Rounds of joins at most, and the share of changed neighbours that ends them.
ROUNDS = 8
SETTLED = 0.01
#: The longest vectors, at which every query begins too.
WAYS_IN = 32
#: Beam of a query, vectors it opens in a round, and rounds at most.
BEAM = 160
OPENED = 24
HOPS = 12

#: Stands for no neighbour.
NONE = np.int64(-(2**63))


def _directions(packed: np.ndarray) -> np.ndarray:
    return packed[:, :-2].astype(np.float32)


def _lengths(packed: np.ndarray) -> np.ndarray:
    """The last two places of a packed vector are the bytes of its length in single precision."""
    return np.ascontiguousarray(packed[:, -2:]).view(np.float32)[:, 0]


def part_of(ids: np.ndarray, parts: int) -> np.ndarray:
    return (mix(ids.view(np.uint64)) % U(parts)).astype(np.int64)


def _split(part: np.ndarray, *columns: np.ndarray):
    """Rows by part: (part, columns of its rows) in turn."""
    if not len(part):
        return
    order = np.argsort(part, kind="stable")
    p = part[order]
    cut = np.flatnonzero(np.concatenate(([True], p[1:] != p[:-1])))
    for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(p)], strict=True):
        yield int(p[a]), [c[order[a:b]] for c in columns]


def _cat(column, kind, width: int | None = None) -> np.ndarray:
    x = np.frombuffer(b"".join(column), kind)
    return x if width is None else x.reshape(-1, width)


def _distinct(ids: np.ndarray, flags: np.ndarray, *columns: np.ndarray):
    """The rows by id, and which of their ids are new. Of copies of an id, one with a flag comes first."""
    order = np.lexsort((~flags, ids), axis=1)
    ids, flags, *columns = (np.take_along_axis(x, order, 1) for x in (ids, flags, *columns))
    new = ids != NONE
    new[:, 1:] &= ids[:, 1:] != ids[:, :-1]
    return new, ids, flags, *columns


def _best(ids: np.ndarray, scores: np.ndarray, flags: np.ndarray, k: int):
    """Of each row, the k best distinct ids; NONE for none. Of copies of an id, one with a flag counts."""
    new, ids, flags, scores = _distinct(ids, flags, scores)
    scores = np.where(new, scores, -np.inf)
    order = np.argsort(-scores, axis=1, kind="stable")[:, :k]
    ids, scores, flags = (np.take_along_axis(x, order, 1) for x in (ids, scores, flags))
    return np.where(np.isfinite(scores), ids, NONE), scores, flags & np.isfinite(scores)


def _both_best(ids: np.ndarray, scores: np.ndarray, lengths: np.ndarray, flags: np.ndarray, k: int):
    """``_best`` of neighbours: first the nearest half by direction, then the best by inner product of the rest."""
    new, ids, flags, scores, lengths = _distinct(ids, flags, scores, lengths)
    scores = np.where(new, scores, -np.inf)
    order = np.argsort(-scores, axis=1, kind="stable")
    ids, scores, flags, lengths = (np.take_along_axis(x, order, 1) for x in (ids, scores, flags, lengths))
    half = k - k // 2
    inner = np.where(np.isfinite(scores), scores, 0) * lengths
    inner = np.where(np.isfinite(scores), inner, -np.inf)
    inner[:, :half] = np.inf  # stay in front, in their order
    order = np.argsort(-inner, axis=1, kind="stable")[:, :k]
    ids, scores, flags, lengths = (np.take_along_axis(x, order, 1) for x in (ids, scores, flags, lengths))
    has = np.isfinite(scores)
    return np.where(has, ids, NONE), scores, np.where(has, lengths, 0), flags & has


def _least(scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """What a new neighbour's direction, or else its inner product, has to exceed, as two columns."""
    half = scores.shape[1] - scores.shape[1] // 2
    has = np.isfinite(scores)
    inner = np.where(has, np.where(has, scores, 0) * lengths, -np.inf)
    return np.column_stack((scores[:, :half].min(1), inner[:, half:].min(1) if half < scores.shape[1] else np.full(len(scores), np.inf))).astype(np.float32)


def _ragged(owner: np.ndarray, n: int, *columns: np.ndarray, fill):
    """Columns of rows with an owner in 0..n-1 as matrices with a row for each owner."""
    order = np.argsort(owner, kind="stable")
    o = owner[order]
    count = np.bincount(o, minlength=n)
    at = np.arange(len(o)) - np.repeat(np.cumsum(count) - count, count)
    out = []
    for c, f in zip(columns, fill, strict=True):
        m = np.full((n, max(1, int(count.max(initial=0)))), f, c.dtype)
        m[o, at] = c[order]
        out.append(m)
    return out


GRAPH = "part long, ids binary, vectors binary, neighbours binary, scores binary, lengths binary, fresh binary, changed long"


class Part:
    """One part of the graph: ids in order, their vectors, and K neighbours of each."""

    def __init__(self, row, dim: int, degree: int):
        self.ids = np.frombuffer(row.ids, np.int64)
        self.vectors = np.frombuffer(row.vectors, np.float16).reshape(-1, dim)
        self.neighbours = np.frombuffer(row.neighbours, np.int64).reshape(-1, degree)
        self.scores = np.frombuffer(row.scores, np.float32).reshape(-1, degree)
        self.lengths = np.frombuffer(row.lengths, np.float32).reshape(-1, degree)
        self.fresh = np.frombuffer(row.fresh, np.bool_).reshape(-1, degree)

    def row_of(self, ids: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ids, ids)


def _start(degree: int, parts: int):
    """Neighbours within a random group, passed on to the parts that their owners belong to."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        ids = rows["vec_id"].to_numpy()
        half = np.stack([np.frombuffer(v, np.float16) for v in rows["vector"]])
        x, size, n = _directions(half), _lengths(half), len(rows)
        a_half = degree - degree // 2
        near, scores, lengths = np.full((n, degree), NONE, np.int64), np.full((n, degree), -np.inf, np.float32), np.zeros((n, degree), np.float32)
        for a in range(0, n, 512):
            s = x[a : a + 512] @ x.T
            s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
            by = s
            for lo, hi in ((0, a_half), (a_half, degree)):
                k = min(hi, n - 1) - lo
                if k > 0:
                    top = np.argpartition(-by, k - 1, axis=1)[:, :k]
                    near[a : a + 512, lo : lo + k], scores[a : a + 512, lo : lo + k], lengths[a : a + 512, lo : lo + k] = ids[top], np.take_along_axis(s, top, 1), size[top]
                    by = by * size  # the rest by inner product
                    np.put_along_axis(by, top, -np.inf, 1)
                    by[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        out = [(p, *(c.tobytes() for c in cols)) for p, cols in _split(part_of(ids, parts), ids, half, near, scores, lengths)]
        return pd.DataFrame(out, columns=["part", "ids", "vectors", "neighbours", "scores", "lengths"])

    return run


def _first(dim: int, degree: int, each: int):
    """A part of the first graph: what the groups of each dealing found."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        owner, vectors = _cat(rows["ids"], np.int64), _cat(rows["vectors"], np.float16, dim)
        near, scores, lengths = (_cat(rows[c], k, each) for c, k in (("neighbours", np.int64), ("scores", np.float32), ("lengths", np.float32)))
        ids, first, at = np.unique(owner, return_index=True, return_inverse=True)
        at = np.repeat(at, each)
        many = _ragged(at, len(ids), near.ravel(), scores.ravel(), lengths.ravel(), fill=(NONE, -np.inf, 0))
        pad = ((0, 0), (0, max(0, degree - many[0].shape[1])))
        many = [np.pad(m, pad, constant_values=f) for m, f in zip(many, (NONE, -np.inf, 0), strict=True)]
        near, score, length, _ = _both_best(*many, np.zeros(many[0].shape, bool), degree)
        return _graph_row(key[0], ids, vectors[first], near, score, length, near != NONE, near.size)

    return run


def _graph_row(part, ids, vectors, neighbours, scores, lengths, fresh, changed) -> pd.DataFrame:
    parts = (ids, vectors.astype(np.float16), neighbours, scores.astype(np.float32), lengths.astype(np.float32), fresh)
    return pd.DataFrame([(part, *(x.tobytes() for x in parts), int(changed))], columns=[c.split()[0] for c in GRAPH.split(", ")])


def _edges(dim: int, degree: int, parts: int):
    """Tell every neighbour whose neighbour it is."""

    def run(batches):
        for rows in batches:
            out = []
            for row in rows.itertuples():
                p = Part(row, dim, degree)
                has = p.neighbours != NONE
                owner = np.broadcast_to(p.ids[:, None], has.shape)[has]
                to, fresh = p.neighbours[has], p.fresh[has]
                out += [(k, *(x.tobytes() for x in cols)) for k, cols in _split(part_of(to, parts), to, owner, fresh)]
            yield pd.DataFrame(out, columns=["part", "to", "owner", "fresh"])

    return run


def _send(dim: int, degree: int, parts: int, reverse: bool):
    """Each vector to the parts of those that will introduce it: the owners it is a neighbour of, and its own neighbours."""

    def run(key: tuple, graph: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        tidy()
        p = Part(next(graph.itertuples()), dim, degree)
        rng = np.random.default_rng(key[0])
        to, owner, fresh = (_cat(told[c], k) for c, k in (("to", np.int64), ("owner", np.int64), ("fresh", np.bool_)))
        row = p.row_of(to)
        # of the owners, some are to be introduced to p.ids[row] in turn; their own parts have their vectors
        order = np.lexsort((rng.random(len(row)), ~fresh, row))
        rank = np.arange(len(row)) - np.searchsorted(row[order], row[order])
        some = order[rank < REVERSE] if reverse else order[:0]
        back, back_to, back_new = owner[some], to[some], fresh[some]
        worst = _least(p.scores, p.lengths)
        out = []
        for k, (a, h, f) in _split(part_of(owner, parts), row, owner, fresh):
            u, back_at = np.unique(a, return_inverse=True)
            out.append((k, p.ids[u].tobytes(), p.vectors[u].tobytes(), worst[u].tobytes(), p.ids[u][back_at].tobytes(), h.tobytes(), f.tobytes(), False))
        for k, (b, t, f) in _split(part_of(back, parts), back, back_to, back_new):
            out.append((k, b"", b"", b"", b.tobytes(), t.tobytes(), f.tobytes(), True))
        return pd.DataFrame(out, columns=[c.split()[0] for c in SENT.split(", ")])

    return run


#: Vectors (who, vectors, worst) and memberships: ``member`` is to be introduced by ``host``; ``ask`` for those whose vector is at the part asked.
SENT = "part long, who binary, vectors binary, worst binary, member binary, host binary, fresh binary, ask boolean"


def _pass_on(dim: int, degree: int, parts: int):
    """Reverse neighbours: the part that has the member's vector sends it to its host."""

    def run(key: tuple, graph: pd.DataFrame, sent: pd.DataFrame) -> pd.DataFrame:
        p = Part(next(graph.itertuples()), dim, degree)
        member, host, fresh = (_cat(sent[c], k) for c, k in (("member", np.int64), ("host", np.int64), ("fresh", np.bool_)))
        worst, out = _least(p.scores, p.lengths), []
        for k, (m, h, f) in _split(part_of(host, parts), member, host, fresh):
            u = p.row_of(np.unique(m))
            out.append((k, p.ids[u].tobytes(), p.vectors[u].tobytes(), worst[u].tobytes(), m.tobytes(), h.tobytes(), f.tobytes(), False))
        return pd.DataFrame(out, columns=[c.split()[0] for c in SENT.split(", ")])

    return run


def _best_met(got: list[tuple[np.ndarray, ...]], size: np.ndarray, degree: int) -> tuple[np.ndarray, ...]:
    """Of those that met, each one's best by direction and by inner product: no others can be among its neighbours."""
    a, b, s = (np.concatenate(c) for c in zip(*got, strict=True))
    order = np.lexsort((b, -s, a))
    a, b, s = a[order], b[order], s[order]
    once = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
    a, b, s = a[once], b[once], s[once]
    rank = np.arange(len(a)) - np.searchsorted(a, a)
    keep = rank < degree - degree // 2
    order = np.lexsort((-s * size[b], a))
    keep[order[rank < degree]] = True  # the groups lie as before
    return a[keep], b[keep], s[keep]


def _introduce(dim: int, degree: int, parts: int):
    """At each host, score all pairs of its members of which one is new to it."""

    def run(key: tuple, sent: pd.DataFrame) -> pd.DataFrame:
        tidy()
        who, first = np.unique(_cat(sent["who"], np.int64), return_index=True)
        half = _cat(sent["vectors"], np.float16, dim)[first]
        x, size = _directions(half), _lengths(half)
        near, inner = _cat(sent["worst"], np.float32, 2)[first].T
        member, host, fresh = (_cat(sent[c], k) for c, k in (("member", np.int64), ("host", np.int64), ("fresh", np.bool_)))
        order = np.lexsort((~fresh, member, host))
        member, host, fresh = member[order], host[order], fresh[order]
        once = np.concatenate((np.ones(min(1, len(host)), bool), (host[1:] != host[:-1]) | (member[1:] != member[:-1])))
        member, host, fresh = member[once], host[once], fresh[once]
        at = np.searchsorted(who, member)
        cut = np.flatnonzero(np.concatenate((np.ones(min(1, len(host)), bool), host[1:] != host[:-1])))
        got: list[tuple[np.ndarray, ...]] = []
        held = 0
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(host)], strict=True):
            k, new = at[a:b], fresh[a:b]
            if len(k) < 2 or not new.any():
                continue
            v = x[k]
            s = v @ v.T
            better = (s > near[k][:, None]) | (s * size[k] > inner[k][:, None])
            np.fill_diagonal(better, False)
            i, j = np.nonzero(better & (new[:, None] | new[None, :]))
            if len(i):
                got.append((k[i].astype(np.int32), k[j].astype(np.int32), s[i, j]))
                held += len(i)
                if held > HELD:
                    got, held = [_best_met(got, size, degree)], 0
        if not got:
            return pd.DataFrame([], columns=["part", "to", "met", "score", "length"])
        a, b, s = _best_met(got, size, degree)
        out = [(k, *(c.tobytes() for c in cols)) for k, cols in _split(part_of(who[a], parts), who[a], who[b], s, size[b])]
        return pd.DataFrame(out, columns=["part", "to", "met", "score", "length"])

    return run


def _update(dim: int, degree: int):
    """Replace the worst neighbours by better ones that were met."""

    def run(key: tuple, graph: pd.DataFrame, met: pd.DataFrame) -> pd.DataFrame:
        tidy()
        p = Part(next(graph.itertuples()), dim, degree)
        n = len(p.ids)
        row = p.row_of(_cat(met["to"], np.int64))
        ids, scores, lengths = _ragged(row, n, _cat(met["met"], np.int64), _cat(met["score"], np.float32), _cat(met["length"], np.float32), fill=(NONE, -np.inf, 0))
        # those had before are not fresh any more, and stay so if they are met again
        old = p.neighbours != NONE
        near, score, length, had = _both_best(
            np.hstack((p.neighbours, ids)), np.hstack((p.scores, scores)), np.hstack((p.lengths, lengths)), np.hstack((old, np.zeros(ids.shape, bool))), degree
        )
        fresh = ~had & (near != NONE)
        return _graph_row(key[0], p.ids, p.vectors, near, score, length, fresh, fresh.sum())

    return run


def build_graph(vectors: DataFrame, dim: int, n: int, *, degree: int = DEGREE, rounds: int = ROUNDS) -> DataFrame:
    """The neighbour graph of (vec_id, vector float16): a packed row for each part."""
    spark = vectors.sparkSession
    parts = max(1, -(-n // PART))
    each = -(-degree // 2)  # two dealings: through both, neighbours of neighbours lead everywhere
    found = vectors.mapInPandas(_deal(parts), "dealing int, part long, vec_id long, vector binary").groupBy("dealing", "part").applyInPandas(
        _start(each, parts), "part long, ids binary, vectors binary, neighbours binary, scores binary, lengths binary"
    )
    graph = settled(found.groupBy("part").applyInPandas(_first(dim, degree, each), GRAPH), "graph")
    for _ in range(rounds):
        edges = graph.select("part", "ids", "vectors", "neighbours", "scores", "lengths", "fresh").mapInPandas(_edges(dim, degree, parts), "part long, to binary, owner binary, fresh binary")
        sent = settled(graph.groupBy("part").cogroup(edges.groupBy("part")).applyInPandas(_send(dim, degree, parts, True), SENT), "sent")
        more = graph.groupBy("part").cogroup(sent.where("ask").groupBy("part")).applyInPandas(_pass_on(dim, degree, parts), SENT)
        met = sent.where("not ask").unionByName(more).groupBy("part").applyInPandas(_introduce(dim, degree, parts), "part long, to binary, met binary, score binary, length binary")
        graph = settled(graph.groupBy("part").cogroup(met.groupBy("part")).applyInPandas(_update(dim, degree), GRAPH), "graph")
        release(spark)
        if (graph.agg(F.sum("changed")).first()[0] or 0) <= SETTLED * n * degree:
            break
    return graph


def _deal(parts: int):
    def run(batches):
        for rows in batches:
            ids = rows["vec_id"].to_numpy(np.int64)
            for dealing in (0, 1):
                at = part_of(mix(ids.view(np.uint64) + U(dealing + 1)).view(np.int64), parts)
                yield rows.assign(dealing=dealing, part=at)[["dealing", "part", "vec_id", "vector"]]

    return run


ADJACENT = "part long, ids binary, neighbours binary, who binary, vectors binary"


def _adjacent(dim: int, degree: int):
    """The graph for searching: each part with its neighbours' vectors."""

    def run(key: tuple, graph: pd.DataFrame, sent: pd.DataFrame) -> pd.DataFrame:
        p = Part(next(graph.itertuples()), dim, degree)
        who, first = np.unique(_cat(sent["who"], np.int64), return_index=True)
        vectors = _cat(sent["vectors"], np.float16, dim)[first]
        cols = [x.tobytes() for x in (p.ids, p.neighbours, who, vectors)]
        return pd.DataFrame([(key[0], *cols)], columns=["part", "ids", "neighbours", "who", "vectors"])

    return run


BEAMS = "part long, queries binary, vectors binary, beam binary, scores binary, opened binary, open long"


class Beams:
    """The beams of a part's queries."""

    def __init__(self, row, dim: int, beam: int):
        self.queries = np.frombuffer(row.queries, np.int64)
        self.vectors = np.frombuffer(row.vectors, np.float16).reshape(-1, dim)
        self.beam = np.frombuffer(row.beam, np.int64).reshape(-1, beam)
        self.scores = np.frombuffer(row.scores, np.float32).reshape(-1, beam)
        self.opened = np.frombuffer(row.opened, np.bool_).reshape(-1, beam)

    def next(self) -> np.ndarray:
        """The best of each beam that are not opened yet."""
        waiting = ~self.opened & (self.beam != NONE)
        return waiting & (np.cumsum(waiting, 1) <= OPENED)

    def row(self, part: int) -> pd.DataFrame:
        waiting = (~self.opened & (self.beam != NONE)).sum()
        cols = (self.queries, self.vectors, self.beam, self.scores, self.opened)
        return pd.DataFrame([(part, *(c.tobytes() for c in cols), int(waiting))], columns=[c.split()[0] for c in BEAMS.split(", ")])


def _enter(dim: int, beam: int, ways: tuple[np.ndarray, np.ndarray]):
    """Queries begin at their own place in the graph, and at the longest vectors."""
    way_ids, way_vectors = ways
    way_x = _directions(way_vectors) * _lengths(way_vectors)[:, None]

    def run(key: tuple, graph: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(asked):
            return pd.DataFrame([], columns=[c.split()[0] for c in BEAMS.split(", ")])
        row = next(graph.itertuples())
        b = Beams.__new__(Beams)
        b.queries = np.sort(asked["node"].to_numpy(np.int64))
        n, k = len(b.queries), min(len(way_ids), beam - 1)
        b.vectors = np.frombuffer(row.vectors, np.float16).reshape(-1, dim)[np.searchsorted(np.frombuffer(row.ids, np.int64), b.queries)]
        b.beam = np.full((n, beam), NONE, np.int64)
        b.beam[:, 0] = b.queries
        b.scores = np.full((n, beam), -np.inf, np.float32)
        b.scores[:, 0] = np.finfo(np.float32).max  # the query itself is no result, but a way in
        own = way_ids[:k] == b.queries[:, None]
        b.beam[:, 1 : k + 1] = np.where(own, NONE, way_ids[:k])
        b.scores[:, 1 : k + 1] = np.where(own, -np.inf, _directions(b.vectors) @ way_x[:k].T)
        b.opened = np.zeros((n, beam), bool)
        return b.row(row.part)

    return run


def _with_part(parts: int):
    def run(batches):
        for rows in batches:
            yield rows.assign(part=part_of(rows["node"].to_numpy(np.int64), parts))

    return run


def _smallest(k: int):
    """Of the ids of each vector (by its hashes), the k smallest that a task has."""

    def run(batches):
        held: list[pd.DataFrame] = []
        size = least = 0
        for rows in batches:
            held.append(rows)
            size += len(rows)
            if size > max(100_000, 2 * least):
                held = [pd.concat(held).sort_values("vec_id").groupby(["a", "b"]).head(k)]
                size = least = len(held[0])
        if held:
            yield pd.concat(held).sort_values("vec_id").groupby(["a", "b"]).head(k)

    return run


def _ask(dim: int, beam: int, parts: int):
    def run(batches):
        for rows in batches:
            out = []
            for row in rows.itertuples():
                b = Beams(row, dim, beam)
                q, c = np.nonzero(b.next())
                node = b.beam[q, c]
                for k, (i, x) in _split(part_of(node, parts), q, node):
                    u, at = np.unique(i, return_inverse=True)
                    out.append((k, row.part, b.queries[u].tobytes(), b.vectors[u].tobytes(), at.tobytes(), x.tobytes()))
            yield pd.DataFrame(out, columns=["part", "back", "queries", "vectors", "at", "nodes"])

    return run


def _answer(dim: int, degree: int):
    """Neighbours of the nodes opened, with their scores."""

    def run(key: tuple, graph: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        tidy()
        out = []
        if len(asked):
            row = next(graph.itertuples())
            ids, who = np.frombuffer(row.ids, np.int64), np.frombuffer(row.who, np.int64)
            near = np.frombuffer(row.neighbours, np.int64).reshape(-1, degree)
            half = np.frombuffer(row.vectors, np.float16).reshape(-1, dim)
            x = _directions(half) * _lengths(half)[:, None]
            for a in asked.itertuples():
                queries, at = np.frombuffer(a.queries, np.int64), np.frombuffer(a.at, np.int64)
                v = _directions(np.frombuffer(a.vectors, np.float16).reshape(-1, dim))
                found = near[np.searchsorted(ids, np.frombuffer(a.nodes, np.int64))]
                q = np.repeat(at, degree)
                found = found.ravel()
                q, found = q[found != NONE], found[found != NONE]
                if not len(q):
                    continue
                order = np.lexsort((found, q))
                q, found = q[order], found[order]
                once = np.concatenate(([True], (q[1:] != q[:-1]) | (found[1:] != found[:-1])))
                q, found = q[once], found[once]
                w = np.searchsorted(who, found)
                score = np.concatenate([np.einsum("ij,ij->i", v[q[i : i + 65536]], x[w[i : i + 65536]]) for i in range(0, len(q), 65536)])
                out.append((a.back, queries[q].tobytes(), found.tobytes(), score.astype(np.float32).tobytes()))
        return pd.DataFrame(out, columns=["part", "queries", "found", "score"])

    return run


def _merge(dim: int, beam: int):
    def run(key: tuple, beams: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        tidy()
        b = Beams(next(beams.itertuples()), dim, beam)
        opened = b.opened | b.next()
        row = np.searchsorted(b.queries, _cat(answers["queries"], np.int64))
        ids, scores = _ragged(row, len(b.queries), _cat(answers["found"], np.int64), _cat(answers["score"], np.float32), fill=(NONE, -np.inf))
        ids = np.where(ids == b.queries[:, None], NONE, ids)
        b.beam, b.scores, b.opened = _best(np.hstack((b.beam, ids)), np.hstack((b.scores, scores)), np.hstack((opened, np.zeros(ids.shape, bool))), beam)
        return b.row(key[0])

    return run


def _results(dim: int, beam: int, few: int):
    """The best of each beam, and the query's own node for its other ids."""

    def run(batches):
        for rows in batches:
            out = []
            for row in rows.itertuples():
                b = Beams(row, dim, beam)
                own = b.beam == b.queries[:, None]
                q, c = np.nonzero((b.beam != NONE) & (np.cumsum(~own, 1) <= few) & ~own)
                out.append(pd.DataFrame({"query": np.concatenate((b.queries, b.queries[q])), "node": np.concatenate((b.queries, b.beam[q, c]))}))
            yield pd.concat(out) if out else pd.DataFrame([], columns=["query", "node"])

    return run


def _scaled(top: float):
    """Directions in half precision, and lengths over the largest one in single precision."""

    def run(batches):
        for rows in batches:
            if len(rows):
                x = np.stack(rows["vector"].to_list()).astype(np.float64) / top
                size = np.sqrt((x * x).sum(1))
                x /= np.maximum(size, np.finfo(np.float64).tiny)[:, None]
                packed = np.column_stack((x.astype(np.float16), size.astype(np.float32)[:, None].view(np.float16)))
                yield pd.DataFrame({"vec_id": rows["vec_id"], "vector": [v.tobytes() for v in packed]})

    return run


def nearest(vectors: DataFrame, *, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", degree: int = DEGREE, beam: int = BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): about the k rows of largest inner product with each query row.

    Queries are the rows whose id is divisible by ``every``; a query's own row is no
    candidate. Scores are inner products of the original vectors in double precision,
    nearest first, ties to the smaller id. Null ids and vectors that are null, zero or
    hold null or non-finite components take no part, nor do vectors of another length
    than the smallest id's. Equal vectors are told by 128 bits of hashes. Rows of one id are one row: that with the least vector.
    Other columns are ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    prepare(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & valid("vector") & F.exists("vector", lambda x: x != 0))
    rows = rows.groupBy("vec_id").agg(F.min("vector").alias("vector"))
    rows = rows.withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0)))  # no zero has a sign
    rows = settled(rows.withColumns({"a": F.xxhash64("vector"), "b": F.xxhash64(F.lit(1), "vector")}), "vectors")
    size = rows.agg(F.min_by(F.size("vector"), "vec_id")).first()[0] or 0
    rows = rows.where(F.size("vector") == size)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    light = rows.select("a", "b", "vec_id")
    few = light.mapInPandas(_smallest(k + 1), "a long, b long, vec_id long").groupBy("a", "b").agg(F.slice(F.array_sort(F.collect_list("vec_id")), 1, k + 1).alias("ids"))
    copies = settled(few.withColumn("node", F.col("ids")[0]), "copies")
    first = rows.groupBy("a", "b").agg(F.min("vec_id").alias("node"), F.first("vector").alias("vector"))  # a partial sum leaves one row for each task
    nodes = settled(first.select("node", "vector"), "nodes")
    named = light.where(F.col("vec_id") % every == 0).select("a", "b", F.col("vec_id").alias("query_id"))
    weights = named.groupBy("a", "b").agg(F.count("*").alias("w")).join(copies.select("a", "b", "node"), ["a", "b"])
    weights = settled(weights.select(F.struct("a", "b").alias("key"), "node", "w"), "asked")
    n, top = nodes.agg(F.count("*"), F.max(F.sqrt(dot(F.col("vector"), F.col("vector"))))).first()
    top = top or 1.0
    dim, parts = size + 2, max(1, -(-n // PART))
    packed = nodes.withColumnRenamed("node", "vec_id").mapInPandas(_scaled(top), "vec_id long, vector binary")
    longest = nodes.orderBy(F.desc(dot(F.col("vector"), F.col("vector"))), "node").limit(WAYS_IN).withColumnRenamed("node", "vec_id")
    longest = longest.mapInPandas(_scaled(top), "vec_id long, vector binary").collect()  # WAYS_IN rows
    ways = np.array([r.vec_id for r in longest], np.int64), _cat([bytes(r.vector) for r in longest], np.float16, dim)
    graph = build_graph(packed, dim, n, degree=degree)
    edges = graph.mapInPandas(_edges(dim, degree, parts), "part long, to binary, owner binary, fresh binary")
    sent = graph.groupBy("part").cogroup(edges.groupBy("part")).applyInPandas(_send(dim, degree, parts, False), SENT)
    adjacent = settled(graph.groupBy("part").cogroup(sent.groupBy("part")).applyInPandas(_adjacent(dim, degree), ADJACENT), "adjacent")
    asking = weights.select("node").mapInPandas(_with_part(parts), "node long, part long")
    beams = settled(graph.groupBy("part").cogroup(asking.groupBy("part")).applyInPandas(_enter(dim, beam, ways), BEAMS), "beams")
    release(spark)
    for _ in range(HOPS):
        asked = beams.mapInPandas(_ask(dim, beam, parts), "part long, back long, queries binary, vectors binary, at binary, nodes binary")
        answers = adjacent.groupBy("part").cogroup(asked.groupBy("part")).applyInPandas(_answer(dim, degree), "part long, queries binary, found binary, score binary")
        beams = settled(beams.groupBy("part").cogroup(answers.groupBy("part")).applyInPandas(_merge(dim, beam), BEAMS), "beams")
        if not beams.agg(F.sum("open")).first()[0]:
            break
    release(spark)
    pairs = beams.mapInPandas(_results(dim, beam, 3 * k), "query long, node long")
    own = nodes.select(F.col("node").alias("query"), F.col("vector").alias("asked"))
    scored = pairs.join(own, "query").join(nodes, "node").select("query", "node", dot(F.col("asked"), F.col("vector")).alias("score"))
    # each query's k + 1 best ids, its own perhaps among them, nearest first and of equals the smaller id
    scored = scored.join(copies.select("node", "ids"), "node").select("query", F.explode("ids").alias("vec_id"), "score")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    best = scored.withColumn("rank", rank).where(F.col("rank") <= k + 1)
    best = best.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("best")).withColumnRenamed("query", "node")
    found = attach(named.select(F.struct("a", "b").alias("key"), "query_id"), settled(weights.join(best, "node").select("key", "best", "w"), "found"), "key", "w")
    found = found.select("query_id", F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("best"))
    found = found.select("query_id", F.posexplode("best").alias("at", "x"))
    return found.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
