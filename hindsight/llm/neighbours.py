"""Approximate nearest neighbours: a graph built by NN-descent in Spark joins, searched greedily.

Equal vectors are one node. Vectors get one more component, kept apart from the others, that makes
all norms equal, so that the largest inner product and the nearest neighbour agree on the graph;
queries have 0 there. Nodes are compared by minus half the squared distance, which stays exact
beside a vector of a far larger norm.

NN-descent starts from blocks of neighbours in the order of the signs towards random hyperplanes,
of ``BLOCK`` to twice as many nodes (or all, if there are fewer) however the rows are partitioned. In
each round every node sends its vector (in 8 bits a component) to the nodes that it knows or that
know it; each node compares what it got, new against all, and tells both of each better pair; every
node keeps its best ``degree``. Reverse lists are cut to ``degree`` by a hash, so a hub receives no
more than any other node, and what one node compares is bounded. Rounds end when few lists change.

A query starts from its own node's links, and in each step expands the best of the ``beam``
nearest it has seen that are not expanded yet; it ends when all of those are. All queries step
together: the frontier is joined to the links, the links to their vectors. The scores returned are
exact inner products in double precision.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, list_array, release, slices, stored

DEGREE = 32
ROUNDS = 8
SETTLED = 0.08
BEAM = 160
EXPAND = 80
BLOCK = 2048
PASSES = 8
STRIP = 256
TOLD = 5


def usable(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id and v (doubles) of the vectors that take part: not null, not zero, all components finite numbers, and of the most frequent length."""
    v = rows[vec_col].cast("array<double>")
    found = rows.select(rows[id_col].cast("long").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull()
        & (F.size("v") > 0)
        & F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
        & F.exists("v", lambda x: x != 0)
    )
    most = found.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return found.where(F.size("v") == most[0]["n"]) if most else found


def _nodes(vectors: DataFrame) -> DataFrame:
    """node, v, x (float32, for search) and q (8 bits a component with a scale, and the levelling component, for building)."""
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    top = vectors.agg(F.max(norm)).first()[0] or 0.0

    def make():
        def step(batch):
            if batch is None or not batch.num_rows:
                return
            v = _matrix(batch.column(1))
            level = np.sqrt(np.maximum(0.0, top - np.einsum("ij,ij->i", v, v)))
            level[level < 1e-6 * np.sqrt(top)] = 0
            scale = np.maximum(np.abs(v).max(axis=1), 1e-30) / 127
            q = np.round(v / scale[:, None]).astype(np.int8)
            packed = np.concatenate([scale.astype("<f4")[:, None].view(np.int8), level.astype("<f4")[:, None].view(np.int8), q], axis=1)
            yield {"node": batch.column(0), "v": batch.column(1), "x": [r.tobytes() for r in v.astype("<f4")], "q": [r.tobytes() for r in packed]}

        return step

    nodes = vectors.groupBy(F.xxhash64("v").alias("node")).agg(F.first("v").alias("v"))
    return arrow_map(nodes, make, "node long, v array<double>, x binary, q binary")


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _raw(column: pa.Array) -> np.ndarray:
    """Equally long binaries as a matrix of bytes, without copying each."""
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32, count=n + 1 + column.offset)[column.offset :]
    return np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]].reshape(n, -1)


def _from_q(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The vectors and their levelling components."""
    raw = _raw(column)
    return raw[:, 8:].view(np.int8).astype(np.float32) * np.ascontiguousarray(raw[:, :4]).view("<f4"), np.ascontiguousarray(raw[:, 4:8]).view("<f4")[:, 0]


def _closeness(x: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Minus half the squared distance of each pair."""
    half = np.einsum("ij,ij->i", x, x) / 2
    return x @ x.T - half[:, None] - half[None, :] - (level[:, None] - level[None, :]) ** 2 / 2


def _in_groups(columns: tuple[str, ...], work):
    """``arrow_map``'s function over whole groups of equal values of the first column, in which the rows are sorted."""

    def make():
        held: list[pa.RecordBatch] = []

        def groups(batch, final):
            at = batch.column(batch.schema.get_field_index(columns[0])).to_numpy()
            cuts = np.flatnonzero(at[1:] != at[:-1]) + 1
            if final:
                cuts = np.append(cuts, len(at))
            held.clear()
            if not len(cuts):
                held.append(batch)
                return
            if cuts[-1] < len(at):
                held.append(batch.slice(int(cuts[-1])))
            yield from work(batch.slice(0, int(cuts[-1])), cuts.tolist())

        def step(batch):
            if batch is None:
                if held:
                    yield from groups(held[0], True)
                return
            if batch.num_rows:
                yield from groups(pa.Table.from_batches([*held, batch]).combine_chunks().to_batches()[0] if held else batch, False)

        return step

    return make


def _lists(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column one after another, and the length of each list."""
    column = batch.column(batch.schema.get_field_index(name))
    return column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _starts(x: np.ndarray, *more: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    change = np.ones(len(x), bool)
    change[1:] = np.logical_or.reduce([v[1:] != v[:-1] for v in (x, *more)])
    return np.flatnonzero(change)


def _start(nodes: DataFrame, dims: int, seed: int, degree: int, count: int, block: int = BLOCK, passes: int = PASSES) -> DataFrame:
    """(u, w, sim, old), lists of each node's best in a block of neighbouring signatures, for each of ``passes`` sets of hyperplanes."""
    blocks = max(1, count // block)
    passes = passes if blocks > 1 else 1
    bits = min(40, max(1, blocks.bit_length()))
    planes = np.random.default_rng(seed).standard_normal((passes, dims, bits)).astype(np.float32)

    def sign():
        def step(batch):
            if batch is None or not batch.num_rows:
                return
            x, level = _from_q(batch.column(1))
            for i in range(passes):
                side = x @ planes[i, :-1] + level[:, None] * planes[i, -1] > 0
                yield {"pass": np.full(len(x), i), "node": batch.column(0), "q": batch.column(1), "at": side.astype(np.int64) @ (1 << np.arange(bits, dtype=np.int64))}

        return step

    signed = arrow_map(nodes.select("node", "q"), sign, "pass long, node long, q binary, at long")
    # the global place of a node: its place in its part of the order, which is written, and the sizes of the parts before
    place = F.monotonically_increasing_id()
    ordered = stored(signed.repartitionByRange("pass", "at", "node").sortWithinPartitions("pass", "at", "node").select("pass", "node", "q", F.shiftright(place, 33).alias("part"), place.bitwiseAND((1 << 33) - 1).alias("i")), "order")
    parts = ordered.groupBy("part").agg(F.count("*").alias("rows")).orderBy("part").collect()  # as many rows as tasks
    before, sizes = 0, []
    for r in parts:
        sizes.append((r["part"], before))
        before += r["rows"]
    starts = nodes.sparkSession.createDataFrame(sizes, "part long, before long")
    # each pass has all nodes: a block lies within one
    inner = F.floor((F.col("before") + F.col("i") - F.col("pass") * count) * blocks / count)
    ranked = ordered.join(F.broadcast(starts), "part").select((F.col("pass") * blocks + inner).alias("block"), "node", "q")

    def best(batch, cuts):
        ids, (x, level) = batch.column(1).to_numpy(), _from_q(batch.column(2))
        half = np.einsum("ij,ij->i", x, x) / 2
        a = 0
        for b in cuts:
            k = min(degree, b - a - 1)
            if k < 1:
                a = b
                continue
            for c in range(a, b, STRIP):
                d = min(b, c + STRIP)
                s = x[c:d] @ x[a:b].T - half[c:d, None] - half[None, a:b]
                if level[a:b].any():
                    s -= (level[c:d, None] - level[None, a:b]) ** 2 / 2
                s[np.arange(d - c), np.arange(c - a, d - a)] = -np.inf
                near = np.argpartition(-s, k - 1, axis=1)[:, :k]
                yield _packed(ids[c:d], np.full(d - c, k), ids[a:b][near].ravel(), np.take_along_axis(s, near, axis=1).ravel()) | {"old": np.zeros(d - c, bool)}
            a = b

    return arrow_map(ranked.repartition("block").sortWithinPartitions("block", "node"), _in_groups(("block",), best), TOLD_SCHEMA)


TOLD_SCHEMA = "u long, w array<long>, sim array<float>, old boolean"
LINKS_SCHEMA = "u long, w array<long>, sim array<float>, old array<boolean>"


def _packed(u: np.ndarray, lengths: np.ndarray, w: np.ndarray, sim: np.ndarray) -> dict:
    return {"u": u, "w": list_array(w, lengths, pa.int64()), "sim": list_array(sim.astype(np.float32), lengths, pa.float32())}


def _keep(told: DataFrame, degree: int) -> DataFrame:
    """The best ``degree`` links of each node among all lists for it, the best first; ``old`` is true for a link it had before."""

    def best(batch, cuts):
        (w, sizes), (sim, _) = _lists(batch, "w"), _lists(batch, "sim")
        u, old = (np.repeat(batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False), sizes) for c in ("u", "old"))
        order = np.lexsort((-sim, w, u))
        u, w, sim, old = u[order], w[order], sim[order], old[order]
        first = _starts(u, w)
        if not len(first):
            return
        u, w, sim, old = u[first], w[first], sim[first], np.logical_or.reduceat(old, first)
        order = np.lexsort((w, -sim, u))
        u, w, sim, old = u[order], w[order], sim[order], old[order]
        first = _starts(u)
        sizes = np.diff(np.append(first, len(u)))
        kept = np.arange(len(u)) - np.repeat(first, sizes) < degree
        sizes = np.minimum(sizes, degree)
        yield _packed(u[first], sizes, w[kept], sim[kept]) | {"old": list_array(old[kept], sizes, pa.bool_())}

    return arrow_map(told.repartition("u").sortWithinPartitions("u"), _in_groups(("u",), best), LINKS_SCHEMA)


def _reverse(links: DataFrame, degree: int) -> DataFrame:
    """Of the nodes that link to u, ``degree`` by the order of a hash: (u, w, old), one row for each."""
    each = links.select("u", F.explode(F.arrays_zip("w", "old")).alias("x")).select("u", "x.w", "x.old")
    rank = F.row_number().over(Window.partitionBy("w").orderBy(F.xxhash64("u", "w"), "u"))
    return each.withColumn("r", rank).where(F.col("r") <= degree).select(F.col("w").alias("u"), F.col("u").alias("w"), "old")


def _messages(nodes: DataFrame, links: DataFrame, degree: int) -> DataFrame:
    """(at, u, q, least, old): each node's vector for those that it knows or that know it, once for each; old if it is so on both sides."""
    back = _reverse(links, degree).groupBy("u").agg(F.collect_list("w").alias("bw"), F.collect_list("old").alias("bold"))
    sent = nodes.select(F.col("node").alias("u"), "q").join(links, "u", "left").join(back, "u", "left").select("u", "q", "w", "sim", "old", "bw", "bold")

    def make():
        def step(whole):
            for batch in slices(whole, 1000) if whole is not None else ():
                (w, n), (sim, _), (old, _), (bw, bn), (bold, _) = (_lists(batch, c) for c in ("w", "sim", "old", "bw", "bold"))
                row, to, flag = np.concatenate([np.repeat(np.arange(len(n)), n), np.repeat(np.arange(len(n)), bn)]), np.concatenate([w, bw]), np.concatenate([old, bold]).astype(bool)
                if not len(to):
                    continue
                order = np.lexsort((to, row))
                row, to, flag = row[order], to[order], flag[order]
                first = _starts(row, to)
                flag, row, to = np.logical_and.reduceat(flag, first), row[first], to[first]
                least = np.full(len(n), -np.inf, np.float32)
                full = n >= degree
                least[full] = sim[(np.cumsum(n) - 1)[full]]  # lists have the best first
                yield {"at": to, "u": batch.column(0).take(pa.array(row)), "q": batch.column(1).take(pa.array(row)), "least": least[row], "old": flag}

        return step

    return arrow_map(sent, make, "at long, u long, q binary, least float, old boolean")


def _meet(messages: DataFrame, told: int) -> DataFrame:
    """At each node, the pairs of what it received that improve one of the two, as lists (u, w, sim, old)."""

    def compare(batch, cuts):
        ids, old, least = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("u", "old", "least"))
        x, level = _from_q(batch.column(batch.schema.get_field_index("q")))
        us, ns, ws, sims = [], [], [], []
        a = 0
        for b in cuts:
            if b - a > 1:
                s = _closeness(x[a:b], level[a:b])
                own = ids[a:b]
                np.fill_diagonal(s, -np.inf)
                stale = old[a:b]
                s[stale[:, None] & stale[None, :]] = -np.inf
                k = min(told, b - a - 1)
                best = np.argpartition(-s, k - 1, axis=1)[:, :k]
                got = np.take_along_axis(s, best, axis=1)
                better = got > least[a:b][:, None]
                row, column = np.nonzero(better)
                count = better.sum(axis=1)
                us.append(own[count > 0])
                ns.append(count[count > 0])
                ws.append(own[best[row, column]])
                sims.append(got[row, column])
            a = b
        if us:
            u = np.concatenate(us)
            yield _packed(u, np.concatenate(ns), np.concatenate(ws), np.concatenate(sims)) | {"old": np.zeros(len(u), bool)}

    return arrow_map(messages.repartition("at").sortWithinPartitions("at", "u"), _in_groups(("at",), compare), TOLD_SCHEMA)


def build(nodes: DataFrame, dims: int, count: int, degree: int = DEGREE, rounds: int = ROUNDS, settled: float = SETTLED, told: int = TOLD, seed: int = 11, block: int = BLOCK) -> DataFrame:
    """The graph's links (u, w, sim, old), lists of at most ``degree`` for each node."""
    links = stored(_keep(_start(nodes, dims, seed, degree, count, block), degree), "links")
    for _ in range(rounds if count > 2 * block else min(rounds, 1)):
        better = _meet(_messages(nodes, links, degree), told)
        now = stored(_keep(links.select("u", "w", "sim", F.lit(True).alias("old")).unionAll(better), degree), "links")
        changed, total = now.agg(F.sum(F.size(F.filter("old", lambda x: ~x))), F.sum(F.size("old"))).first()
        links = now
        release(nodes)
        if not total or changed <= settled * total:
            break
    return links


def _unseen(met: DataFrame, seen: list[DataFrame]) -> DataFrame:
    """(query, node) of the ids that each query has met and not seen, from lists (query, ids)."""

    def work(batch, cuts):
        (ids, sizes), now = _lists(batch, "ids"), batch.column(1).to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        queries, nodes = [], []
        a = 0
        for b in cuts:
            m = b - int(now[a:b].sum())  # what was seen comes first
            new = np.setdiff1d(ids[ends[m] : ends[b]], ids[ends[a] : ends[m]])
            nodes.append(new)
            queries.append(np.repeat(batch.column(0)[a].as_py(), len(new)))
            a = b
        yield {"query": np.concatenate(queries).astype(np.int64), "node": np.concatenate(nodes).astype(np.int64)}

    rows = reduce(DataFrame.unionAll, (x.select("query", F.lit(False).alias("now"), F.col("fresh").alias("ids")) for x in seen), met.select("query", F.lit(True).alias("now"), F.col("to").alias("ids")))
    return arrow_map(rows.repartition("query").sortWithinPartitions("query", "now"), _in_groups(("query",), work), "query long, node long")


_STATE = "query long, state binary, front array<long>, fresh array<long>"


def _pack(a: np.ndarray, ids: np.ndarray, sims: np.ndarray, done: np.ndarray) -> bytes:
    return np.array([len(a), len(ids)], "<i8").tobytes() + ids.astype("<i8").tobytes() + a.astype("<f4").tobytes() + sims.astype("<f4").tobytes() + done.astype(np.int8).tobytes()


def _unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    d, n = np.frombuffer(raw, "<i8", 2).tolist()
    at = 16 + 8 * n
    return np.frombuffer(raw, "<f4", d, at), np.frombuffer(raw, "<i8", n, 16), np.frombuffer(raw, "<f4", n, at + 4 * d), np.frombuffer(raw, np.int8, n, at + 4 * d + 4 * n).astype(bool)


def _first(queries: DataFrame) -> DataFrame:
    """Each query's state before the search: its own node, which is kept as the nearest and is to be expanded."""

    def make():
        def step(batch):
            if batch is None or not batch.num_rows:
                return
            ids = batch.column(0).to_numpy()
            own = list_array(ids, [1] * len(ids), pa.int64())
            yield {"query": ids, "state": [_pack(a, ids[i : i + 1], np.full(1, np.inf), np.ones(1)) for i, a in enumerate(_raw(batch.column(1)).copy().view("<f4"))], "front": own, "fresh": own}

        return step

    return arrow_map(queries.select("query", "a"), make, _STATE)


def _advance(state: DataFrame, new: DataFrame, beam: int, expand: int) -> DataFrame:
    """Each query's state with the nodes ``new`` (query, node, q) among its nearest, and the next ones to expand, which count as done.

    A state is one value, as every further column is one more for each of the new nodes.
    """
    rows = new.select("query", "node", "q").unionAll(state.select("query", F.lit(None).cast("long"), "state"))

    def work(batch, cuts):
        node_of, q = batch.column(1), batch.column(2)
        fresh = node_of.is_valid().to_numpy(zero_copy_only=False)
        upto, nodes = np.concatenate([[0], np.cumsum(fresh)]), node_of.drop_null().to_numpy()
        x = _from_q(q.filter(pa.array(fresh)))[0] if fresh.any() else np.zeros((0, 0), np.float32)
        states = q.filter(pa.array(~fresh)).to_pylist()
        out = {"query": [], "state": [], "front": [], "fresh": []}
        a = 0
        for g, b in enumerate(cuts):  # each group has one state, and groups are in order
            i, j = upto[a], upto[b]
            asked, ids, sims, done = _unpack(states[g])
            own = nodes[i:j]
            node, was = np.concatenate([ids, own]), np.concatenate([done, np.zeros(j - i, bool)])
            sim = np.concatenate([sims, x[i:j] @ asked]) if j > i else sims
            order = np.lexsort((node, -sim))[:beam]
            node, sim, was = node[order], sim[order], was[order]
            front = np.flatnonzero(~was)[:expand]
            was[front] = True
            for c, v in (("query", batch.column(0)[a].as_py()), ("state", _pack(asked, node, sim, was)), ("front", node[front]), ("fresh", own)):
                out[c].append(v)
            a = b
        if out["query"]:
            yield out | {c: list_array(np.concatenate(out[c]), [len(v) for v in out[c]], pa.int64()) for c in ("front", "fresh")}

    return arrow_map(rows.repartition("query").sortWithinPartitions("query"), _in_groups(("query",), work), _STATE)


def _pool(state: DataFrame) -> DataFrame:
    """(query, node, sim) of what the states hold."""

    def make():
        def step(batch):
            if batch is None or not batch.num_rows:
                return
            held = [_unpack(x) for x in batch.column(1).to_pylist()]
            yield {"query": np.repeat(batch.column(0).to_numpy(), [len(h[1]) for h in held]), "node": np.concatenate([h[1] for h in held]), "sim": np.concatenate([h[2] for h in held])}

        return step

    return arrow_map(state.select("query", "state"), make, "query long, node long, sim float")


def search(nodes: DataFrame, links: DataFrame, queries: DataFrame, degree: int = DEGREE, beam: int = BEAM, expand: int = EXPAND, most_steps: int = 40) -> DataFrame:
    """(query, node, sim) of the ``beam`` nearest nodes that the greedy search has seen. ``queries``: query, which is a node, and a, its vector.

    A query is one row with lists, and so is a node with its links: rows of their own are only nodes that a query has not seen.
    """
    around = links.select("u", F.explode("w").alias("w")).unionAll(_reverse(links, 2 * degree).select("u", "w")).distinct()
    around = stored(around.groupBy(F.col("u").alias("node")).agg(F.collect_list("w").alias("to")), "around")
    vectors = nodes.select("node", "q")
    seen = [state := stored(_first(queries), "state")]  # by step; only the nearest of them stay in a state
    for _ in range(most_steps):
        front = state.select("query", F.explode("front").alias("node"))
        if front.isEmpty():
            break
        met = _unseen(front.join(around, "node"), seen)
        state = stored(_advance(state, met.join(vectors, "node"), beam, expand), "state")
        seen.append(state)
        release(nodes)
    return _pool(state)


def nearest(rows: DataFrame, is_query, top: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", degree: int = DEGREE, beam: int = BEAM) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the ``top`` rows found nearest to each query row.

    ``is_query`` is a condition on ``vec_id``. Every usable row but the query's own is a candidate.
    Vectors that are null, zero, of an odd length, or hold null or non-finite components take no part,
    nor do rows without an id. Ties go to the smaller id; of equal vectors all rows are candidates.
    A table of one usable row gives no result. Columns other than the two named are not read.
    """
    found = usable(rows, id_col, vec_col).withColumn("node", F.xxhash64("v"))
    members = found.select("node", "vec_id").withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy("vec_id"))).where(F.col("r") <= top + 1).drop("r")
    nodes = stored(_nodes(found.select("v")), "nodes")
    count = nodes.count()
    dims = nodes.select(F.size("v")).first()
    asked = found.where(is_query).select(F.col("vec_id").alias("query_id"), F.col("node").alias("query"))
    if count < 2:
        reached = asked.select("query", F.col("query").alias("node")).distinct().withColumn("sim", F.lit(0.0))
    else:
        links = build(nodes, dims[0] + 1, count, degree)
        own = nodes.select(F.col("node").alias("query"), "x").join(asked.select("query").distinct(), "query", "left_semi")
        reached = search(nodes, links, own.select("query", F.col("x").alias("a")), degree, beam)
    near = reached.select("query", "node")
    a, b = nodes.select(F.col("node").alias("query"), F.col("v").alias("a")), nodes.select("node", F.col("v").alias("b"))
    scored = _exact(near.join(a, "query").join(b, "node"))
    pairs = asked.join(scored, "query").join(members, "node").where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _exact(rows: DataFrame) -> DataFrame:
    def make():
        def step(batch):
            if batch is None or not batch.num_rows:
                return
            yield {"query": batch.column(0), "node": batch.column(1), "score": np.einsum("ij,ij->i", _matrix(batch.column(2)), _matrix(batch.column(3)))}

        return step

    return arrow_map(rows.select("query", "node", "a", "b"), make, "query long, node long, score double")
