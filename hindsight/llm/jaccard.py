"""Exact Jaccard self-join of documents as sets of word n-grams, as a size-aware heavy-light join.

Two documents link when ``100 * intersection >= percent * union``. Equal sets are one set from the
start. Of the distinct sets,

* *light* ones (small) enumerate every subset that can be what they share with a partner, all of
  the sizes that the threshold allows; in each group of an equal subset the smallest set is tied
  to every other one, which keeps everything connected that the group shows to be linked;
* *heavy* ones (large) enter inverted lists under the rarest of their n-grams, as many as the
  threshold needs, and the lists are scanned under length and position bounds.

The boundary is the size at which the sum of both costs over the sizes found is least. A set
near the boundary takes part on both sides, so that no pair falls between them.

Sets that link share not one but several of their rare n-grams: with prefixes of p(a) and p(b)
n-grams and a required intersection o, at least min(p(a) - (a - o), p(b) - (b - o)). Pairs that
cannot reach this number are dropped before anything is read.

The postings are shuffled once, by key and in the order of rarity, and each list is read as a run:
sets whose size allows no link within a short list leave it, and what stays is written with
the list's leader, the set with the fewest rarer n-grams.

A list is not expanded into its pairs. First every list offers only its leader's pairs; then each
list of ``BIG`` sets or more those of a second leader, the set with the most links so far. What is
verified joins components. The last round takes the pairs of a list that are still in different
components and pass the bounds; it loses no link between components, and pairs within one are
not needed to know the classes. A pair is judged at the first n-gram that it shares: where one of
the two leads that list in the first round, else in the last.

Each set has a parity sketch: 512 bits, of which every n-gram flips the one that its hash names.
Two sketches differ in no more bits than the sets in n-grams, so a pair whose sketches differ in
more than the threshold allows is out before its n-grams are read, and no true link ever is. Of
large sets, whose parities are all but random, the n-grams in each of 512 cells are counted, modulo
256; the counts differ by no more than the sets, either.

Rarity comes from a count sketch over all n-grams of all documents: a fixed table of 2**18
counters, 2 MB at any size of the corpus. It only orders the n-grams; a wrong count costs time,
never a link. N-grams are known by 64 bits of hash, sets by 64 bits that are checked against
another 64: if two different sets agree in the first, another seed is taken.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shingles
from .common import arrow_map, contracted, cut, empty_as, hooked, list_array, sized, stored
from .shingles import identity

SHINGLE, PERCENT = 3, 90
SKETCH_BITS = 18
CHUNK = 1 << 15
BROADCAST_ROWS = 100_000
#: Cost of a posting, with the verification that it may lead to, in subset keys.
POSTING_COST = 12
LARGEST_LIGHT = 40
#: Numbers of 64 bits in a set's parity sketch.
PARITY = 8
#: Cells of a large set's counts, and the size from which a set has them.
CELLS, COUNTED_FROM = 512, 400
#: Sets of a list from which it gets a second leader.
BIG = 10
#: Up to this distance in a list's order every set is held against its neighbours; longer lists stay whole.
NEAR = 8
#: Sets of an unfinished list that are held at once.
HELD = 1 << 16

_U = np.uint64


def required(a: Column, b: Column, percent: int) -> Column:
    """The least intersection with which sets of these sizes link."""
    return F.ceil(F.lit(percent) * (a + b) / F.lit(100.0 + percent) - F.lit(1e-9))


def prefix(n: int, percent: int) -> int:
    """How many of a set's rarest n-grams must hold one that it shares with a partner."""
    return n - -(-percent * n // 100) + 1


def deletions(n: int, percent: int) -> int:
    """How many of a set's n-grams a partner may lack at most."""
    return n - -(-percent * n // 100)


def subset_count(n: int, percent: int) -> int:
    return sum(math.comb(n, d) for d in range(deletions(n, percent) + 1))


def boundary(sizes: dict[int, int], percent: int) -> int:
    """The largest light size: the one with the least total cost, given how many sets of each small size there are."""
    heavy = lambda n: POSTING_COST * prefix(n, percent)
    small = range(1, LARGEST_LIGHT + 1)

    def cost(b: int) -> float:
        return sum(sizes.get(n, 0) * ((subset_count(n, percent) if n <= b else 0) + (heavy(n) if 100 * n >= percent * (b + 1) else 0)) for n in small)

    return min(range(LARGEST_LIGHT + 1), key=cost)


def _bucket(tokens: np.ndarray) -> np.ndarray:
    return (tokens & _U((1 << SKETCH_BITS) - 1)).astype(np.int64)


_PARITIES = [f"parity{i}" for i in range(PARITY)]


def parity(tokens: np.ndarray) -> np.ndarray:
    bits = np.bincount((tokens >> _U(40)).astype(np.int64) % (64 * PARITY), minlength=64 * PARITY) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def _near_parity(a: str, b: str, percent: int) -> Column:
    """Whether the sketches differ in no more bits than sets that link can differ in n-grams."""
    differ = sum((F.bit_count(F.col(f"{p}{a}").bitwiseXOR(F.col(f"{p}{b}"))) for p in _PARITIES), F.lit(0))
    na, nb = F.col(f"n{a}"), F.col(f"n{b}")
    return differ <= na + nb - 2 * required(na, nb, percent)


def cells(tokens: np.ndarray) -> bytes | None:
    """The n-grams in each cell, modulo 256; None for a small set."""
    if len(tokens) < COUNTED_FROM:
        return None
    return np.bincount((tokens >> _U(40)).astype(np.int64) % CELLS, minlength=CELLS).astype(np.uint8).tobytes()


def _scan(docs: DataFrame, k: int, seed: int) -> DataFrame:
    """A row for each document (its id and hash, its set's size, identity and sketches) and, from each task, its share of the count sketch in chunks."""

    def make():
        counts = np.zeros(1 << SKETCH_BITS, dtype=np.int64)

        def step(batch):
            if batch is None:
                for c in range(0, len(counts), CHUNK):
                    yield {"doc_id": [None], "row_hash": [0], "n": [-1], "sid": [c // CHUNK], "check": [0], "counts": [counts[c : c + CHUNK].astype("<i8").tobytes()], "cells": [None]} | dict.fromkeys(_PARITIES, [0])
                return
            for part, texts in shingles.runs(batch):
                found = shingles.sets(texts, k, seed)
                np.add(counts, np.bincount(_bucket(np.concatenate(found)), minlength=len(counts)), out=counts)
                ids = [identity(s, seed) if len(s) else (None, None) for s in found]
                yield {"doc_id": part.column(0), "row_hash": part.column(2), "n": [len(s) for s in found], "sid": [x for x, _ in ids], "check": [x for _, x in ids], "counts": [None] * len(found), "cells": [cells(s) for s in found]} | dict(zip(_PARITIES, np.stack([parity(s) for s in found]).T.copy(), strict=True))

        return step

    return arrow_map(docs.withColumn("row_hash", F.xxhash64(empty_as(F.col("text")))), make, "doc_id long, row_hash long, n long, sid long, check long, counts binary, cells binary, " + ", ".join(f"{p} long" for p in _PARITIES))


def _sketch(scanned: DataFrame) -> np.ndarray:
    """The sum of all tasks' counters."""

    def make():
        held: dict[int, np.ndarray] = {}

        def step(batch):
            if batch is None:
                yield {"chunk": list(held), "counts": [x.tobytes() for x in held.values()]}
                return
            for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = np.frombuffer(data.as_py(), dtype="<i8")
                held[chunk] = held[chunk] + x if chunk in held else x

        return step

    chunks = (1 << SKETCH_BITS) // CHUNK
    rows = scanned.where("n < 0").select(F.col("sid").alias("chunk"), "counts").repartition(chunks, "chunk")
    total = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
    for r in arrow_map(rows, make, "chunk long, counts binary").collect():  # as many rows as chunks
        total[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] += np.frombuffer(r["counts"], dtype="<i8")
    return np.minimum(total, (1 << 32) - 1).astype(np.uint32)


def _postings(docs: DataFrame, k: int, seed: int, percent: int, light: int, sketch) -> DataFrame:
    """Subset keys of light sets (pos = -1) and rare n-grams of heavy ones, once for each set in what a task has seen lately."""

    def subsets(tokens: np.ndarray) -> tuple[list[int], list[int]]:
        """Keys of what is left of a set without any allowed number of its tokens, and minus what is left."""
        x = shingles.mix(tokens)
        whole, x, n = int(x.sum(dtype=np.uint64)), x.tolist(), len(x)
        keys, left = [], []
        for d in range(deletions(n, percent) + 1):
            for gone in itertools.combinations(x, d):
                keys.append((whole - sum(gone)) & ((1 << 64) - 1))
                left.append(d - n)
        return keys, left

    def make():
        counts = sketch.value
        seen: set[int] = set()

        def step(batch):
            for _, texts in shingles.runs(batch) if batch is not None else ():
                keys, places, sids, sizes, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [], [], []
                for s in shingles.sets(texts, k, seed):
                    n = len(s)
                    if not n:
                        continue
                    sid = identity(s, seed)[0]
                    if sid in seen:
                        continue
                    if len(seen) >= 100_000:
                        seen.clear()
                    seen.add(sid)
                    made = 0
                    if n <= light:
                        own, left = subsets(s)
                        keys.append(np.array(own, dtype=np.uint64))
                        places.append(np.array(left))
                        made += len(own)
                    if 100 * n >= percent * (light + 1):
                        p = prefix(n, percent)
                        rarity = counts[_bucket(s)].astype(np.uint64) << _U(32) | s >> _U(32)
                        keys.append(s[np.argsort(rarity, kind="stable")[:p]])
                        places.append(np.arange(p))
                        made += p
                    sids.append(sid)
                    sizes.append(n)
                    rows.append(made)
                yield {
                    "key": pa.array(np.concatenate(keys).view(np.int64)), "sid": pa.array(np.repeat(np.array(sids, dtype=np.int64), rows)),
                    "n": pa.array(np.repeat(np.array(sizes, dtype=np.int32), rows)), "pos": pa.array(np.concatenate(places).astype(np.int32)),
                }

        return step

    return arrow_map(docs.select("text"), make, "key long, sid long, n int, pos int")


def required_of(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return -(-percent * (a + b) // (100 + percent))


def compatible(na: np.ndarray, nb: np.ndarray, pa: np.ndarray, pb: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes can link; in a group of an equal subset it must be large enough. Places in lists are not looked at, as all that a pair shares is counted."""
    return (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & ((pa >= 0) | (-pa >= required_of(na, nb, percent)))


def possible_of(na: np.ndarray, nb: np.ndarray, pa: np.ndarray, pb: np.ndarray, percent: int) -> np.ndarray:
    """``_possible`` in numpy, for places in lists."""
    return (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & (np.minimum(na - pa, nb - pb) >= required_of(na, nb, percent))


_LISTED = "key long, light boolean, sid long, n int, pos int, m int, open boolean, l_sid long, l_n int, l_pos int"


def _listed(postings: DataFrame, percent: int) -> DataFrame:
    """The sets of each list of two or more that may hold a link, with the list's size m (from those held at once) and leader; ``open`` where the list may show it a link with another set than the leader."""

    def make():
        held: list[pa.Table] = []
        led: list[tuple] = []  # key, kind and leader of a list too long to be held, of which rows have gone out

        def rows(key, light, sid, n, pos, m, free, leader):
            return {"open": pa.array(free), "key": pa.array(key), "light": pa.array(light), "sid": pa.array(sid), "n": pa.array(n.astype(np.int32)), "pos": pa.array(pos.astype(np.int32)), "m": pa.array(m.astype(np.int32))} | {
                f"l_{c}": pa.array(x) for c, x in zip(("sid", "n", "pos"), leader, strict=True)
            }

        def lists(table, final):
            key, sid, n, pos = (table.column(c).to_numpy().astype(np.int64) for c in ("key", "sid", "n", "pos"))
            light = pos < 0
            new = np.ones(len(key), dtype=bool)
            new[1:] = (key[1:] != key[:-1]) | (light[1:] != light[:-1])
            held.clear()
            if not final:
                last = int(np.flatnonzero(new)[-1])
                going_on = bool(led) and led[-1][:2] == (key[last], light[last])
                if going_on or len(key) - last < HELD:
                    if not going_on:
                        held.append(table.slice(last))
                        key, sid, n, pos, light, new = (x[:last] for x in (key, sid, n, pos, light, new))
                else:
                    led.append((key[last], light[last], sid[last], n[last], pos[last]))
            if not len(key):
                return
            keep = new.copy()
            keep[1:] |= sid[1:] != sid[:-1]
            key, sid, n, pos, light, new = (x[keep] for x in (key, sid, n, pos, light, new))
            number = np.cumsum(new) - 1
            sizes = np.bincount(number)
            for k, kind, *leader in led:
                # rows of a list too long to be held: all of it is tied to the set that it began with
                mine = (key == k) & (light == kind)
                if mine.any():
                    size = int(mine.sum())
                    yield rows(key[mine], light[mine], sid[mine], n[mine], pos[mine], np.full(size, HELD), ~light[mine], [np.full(size, x, dtype=t) for x, t in zip(leader, (np.int64, np.int32, np.int32), strict=True)])
                    number, key, sid, n, pos, light = (x[~mine] for x in (number, key, sid, n, pos, light))
            del led[:-1]
            alive = sizes[number] > NEAR + 1
            for d in range(1, NEAR + 1):
                if d >= len(number):
                    break
                i = np.flatnonzero((number[d:] == number[:-d]) & (sizes[number[d:]] <= NEAR + 1))
                i = i[compatible(n[i], n[i + d], pos[i], pos[i + d], percent)]
                alive[i] = True
                alive[i + d] = True
            key, sid, n, pos, light, number = (x[alive] for x in (key, sid, n, pos, light, number))
            if not len(key):
                return
            first = np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1])))
            m = np.diff(np.append(first, len(number)))
            at, m = np.repeat(first, m), np.repeat(m, m)
            follows = (at != np.arange(len(at))) & ~light
            free = follows & (m > NEAR + 1)
            for d in range(1, min(NEAR, len(at))):
                i = np.flatnonzero((number[d:] == number[:-d]) & follows[:-d] & (m[d:] <= NEAR + 1))
                i = i[possible_of(n[i], n[i + d], pos[i], pos[i + d], percent)]
                free[i] = True
                free[i + d] = True
            yield rows(key, light, sid, n, pos, m, free, [sid[at], n[at].astype(np.int32), pos[at].astype(np.int32)])

        def step(batch):
            if batch is None:
                if held:
                    yield from lists(held[0], True)
            elif batch.num_rows:
                yield from lists(pa.Table.from_batches([batch]) if not held else pa.concat_tables([held[0], pa.Table.from_batches([batch])]).combine_chunks(), False)

        return step

    light = F.col("pos") < 0
    ordered = postings.repartition("key").sortWithinPartitions("key", light, F.when(light, F.col("n")).otherwise(F.col("pos")), "sid")
    return arrow_map(ordered, make, _LISTED)


def _tokens(docs: DataFrame, k: int, seed: int) -> DataFrame:
    """Each row's set, with its identity."""

    def make():
        def step(batch):
            for _, texts in shingles.runs(batch) if batch is not None else ():
                found = shingles.sets(texts, k, seed)
                yield {"sid": [identity(s, seed)[0] for s in found], "tokens": list_array(np.concatenate(found).view(np.int64), [len(s) for s in found], pa.int64())}

        return step

    return arrow_map(docs.select("text"), make, "sid long, tokens array<long>")


def _near_counts(pairs: DataFrame, percent: int) -> DataFrame:
    """Of (a, b, n_a, n_b, x, y) the pairs whose counts x and y by cell differ in no more than the threshold allows."""

    def make():
        def step(batch):
            if batch is None or not batch.num_rows:
                return
            na, nb = (batch.column(i).to_numpy().astype(np.int64) for i in (2, 3))
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint8).reshape(-1, CELLS).astype(np.int16) for i in (4, 5))
            differ = np.abs(x - y)
            near = np.minimum(differ, 256 - differ).sum(axis=1) <= na + nb - 2 * required_of(na, nb, percent)
            yield {c: batch.column(i).filter(pa.array(near)) for i, c in enumerate(("a", "b"))}

        return step

    return arrow_map(pairs, make, "a long, b long")


def _verified(pairs: DataFrame, docs: DataFrame, scanned: DataFrame, holders: DataFrame, shingle: int, seed: int, percent: int) -> DataFrame:
    """The distinct pairs (a, b) that link, cut. Sets of pairs whose sketches allow it alone are read, each from one document, ``holders`` (sid, id, n and sketch)."""
    for side in ("a", "b"):
        pairs = pairs.join(holders.select(F.col("sid").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in ("n", *_PARITIES))), side)
    pairs = cut(pairs.where(_near_parity("_a", "_b", percent)).select("a", "b", "n_a", "n_b"))
    large = F.least("n_a", "n_b") >= COUNTED_FROM
    count, counted = pairs.agg(F.count("*"), F.count_if(large)).first()
    if counted:
        asked = pairs.where(large)
        counts = scanned.where(F.col("n") >= COUNTED_FROM).select("sid", "cells").join(sized(cut(_nodes(asked)), BROADCAST_ROWS), "sid", "left_semi").dropDuplicates(["sid"])
        for side, x in (("a", "x"), ("b", "y")):
            asked = asked.join(counts.select(F.col("sid").alias(side), F.col("cells").alias(x)), side)
        pairs = cut(pairs.where(~large).select("a", "b").unionAll(_near_counts(asked.select("a", "b", "n_a", "n_b", "x", "y"), percent)))
    if not count:
        return pairs.select("a", "b")
    wanted = cut(holders.select("sid", "id").join(_nodes(pairs), "sid", "left_semi"))
    few = sized(wanted, BROADCAST_ROWS)
    texts = docs.join(few.select("id"), docs["doc_id"].eqNullSafe(F.col("id")), "left_semi")
    tokens = _tokens(texts, shingle, seed).join(few.select("sid"), "sid", "left_semi").repartition("sid")
    left = tokens.select(F.col("sid").alias("a"), F.col("tokens").alias("x"))
    right = tokens.select(F.col("sid").alias("b"), F.col("tokens").alias("y"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("x", "y"))
    linked = both.select("a", "b", shared.alias("o"), (F.size("x") + F.size("y")).alias("s")).where(100 * F.col("o") >= percent * (F.col("s") - F.col("o"))).select("a", "b")
    return cut(linked.distinct())


def _nodes(pairs: DataFrame) -> DataFrame:
    return _nodes_of(pairs).distinct()


def _least_shared(a: str, b: str, percent: int) -> Column:
    """How many of their rare n-grams two sets of these sizes share at least if they link."""
    na, nb = F.col(a), F.col(b)
    o = required(na, nb, percent)
    spare = lambda n: n - F.ceil(F.lit(percent) * n / F.lit(100.0) - F.lit(1e-9)) + 1 - n + o
    return F.least(spare(na), spare(nb))


def _possible(a: tuple[str, str], b: tuple[str, str], percent: int) -> Column:
    """Whether sets with these sizes and places of a shared n-gram, the first that they share, can link."""
    (na, pa_), (nb, pb) = ((F.col(n), F.col(p)) for n, p in (a, b))
    least = required(na, nb, percent)
    lists = (F.least(na - pa_, nb - pb) >= least) & (pa_ >= 0) & (pb >= 0)
    subset = (pa_ < 0) & (pb < 0) & (-pa_ >= least)
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & (lists | subset)


def classes(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest id reachable by links) of each row.

    Null texts, empty texts and texts of blanks have the empty set, link with nothing and are
    their own component. Rows with a null id take part but give no component its name; a component
    of such rows only has none. Repeated rows are in one component. Columns other than the two
    named are not read.
    """
    found = _members(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")), shingle, percent)
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _members(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """doc_id, row_hash and n of each row; group, component_id and ``tied`` (true) where its group has several rows."""
    spark = docs.sparkSession
    for seed in range(64):
        scanned = stored(_scan(docs, shingle, seed), "sets")
        sets = scanned.where("n > 0").groupBy("sid").agg((F.min("check") != F.max("check")).alias("clash"), F.min("n").alias("n"))
        sizes = {r["size"]: r for r in sets.groupBy(F.least("n", F.lit(LARGEST_LIGHT + 1)).alias("size")).agg(F.count("*").alias("count"), F.max("clash").alias("clash")).collect()}
        if not any(r["clash"] for r in sizes.values()):
            break
    else:
        raise RuntimeError("sets share their identity under every seed")
    light = boundary({n: r["count"] for n, r in sizes.items() if n <= LARGEST_LIGHT}, percent)
    sketch = spark.sparkContext.broadcast(_sketch(scanned))

    lists = stored(_listed(_postings(docs, shingle, seed, percent, light, sketch), percent), "lists")
    labels = _labels(docs, lists, scanned, shingle, seed, percent)
    rows = scanned.where("n >= 0").select("doc_id", "row_hash", "n", "sid")
    if labels is not None:
        rows = rows.join(sized(labels, BROADCAST_ROWS), rows["sid"] == labels["node"], "left").select("doc_id", "row_hash", "n", F.coalesce("up", "sid").alias("group"))
    else:
        rows = rows.select("doc_id", "row_hash", "n", F.col("sid").alias("group"))
    named = rows.where("group is not null").groupBy("group").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("rows")).where("rows > 1").select("group", "component_id", F.lit(True).alias("tied"))
    named = cut(named)
    return rows.join(sized(named, BROADCAST_ROWS), "group", "left")


def _labels(docs: DataFrame, lists: DataFrame, scanned: DataFrame, shingle: int, seed: int, percent: int) -> DataFrame | None:
    """(node, up) of the sets that link with another: sets with the same ``up`` are one component. None if no two link."""
    holders = scanned.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("id"), F.min("n").cast("int").alias("n"), *(F.min(p).alias(p) for p in _PARITIES))
    holders = stored(holders, "holders")
    verified = lambda pairs: _verified(pairs, docs, scanned, holders, shingle, seed, percent)
    ordered = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    ratio = 100 * F.least("n", "l_n") >= percent * F.greatest("n", "l_n")

    # wide: in how many lists of three or more a set stands; two sets share no more of them than either has
    near = lists.withColumn("wide", F.sum((~F.col("light") & (F.col("m") > 2)).cast("int")).over(Window.partitionBy("sid"))).where((F.col("sid") != F.col("l_sid")) & ratio)
    # every shared n-gram counts, one of them, the first, must be in places that allow a link
    near = near.groupBy(*ordered("sid", "l_sid")).agg(
        F.count("*").alias("c"), F.max("light").alias("light"), F.min("wide").alias("more"), F.min(_least_shared("n", "l_n", percent)).alias("least"),
        F.max(_possible(("n", "pos"), ("l_n", "l_pos"), percent)).alias("possible"),
    )
    edges = verified(near.where(F.col("possible") & (F.col("light") | (F.col("c") + F.col("more") >= F.col("least")))).select("a", "b"))

    # a second leader of long lists: the one with the most links, so that what is left apart in them is little
    long = lists.where(~F.col("light") & (F.col("m") >= BIG)).select("key", "sid", "n", "pos")
    if not edges.isEmpty() and not long.isEmpty():
        links = _nodes_of(edges).groupBy("sid").agg(F.count("*").alias("links"))
        known = cut(hooked(edges).join(links.withColumnRenamed("sid", "node"), "node"))
        now = long.join(sized(known, BROADCAST_ROWS), F.col("sid") == F.col("node"), "left").select("key", "sid", "n", "pos", F.coalesce("up", "sid").alias("up"), (-F.coalesce("links", F.lit(0).cast("long"))).alias("r"))
        leaders = now.groupBy("key").agg(F.min(F.struct("r", "pos", "sid", "n", "up")).alias("l")).select("key", *(F.col(f"l.{c}").alias(f"l_{c}") for c in ("sid", "n", "pos", "up")))
        pairs = now.join(leaders, "key").where((F.col("up") != F.col("l_up")) & _possible(("n", "pos"), ("l_n", "l_pos"), percent))
        edges = cut(edges.unionAll(verified(pairs.select(*ordered("sid", "l_sid")).distinct())))
    labels = contracted(edges)

    # what is still apart: sizes in bands of the threshold's ratio, each set meets larger ones of its own band and the next
    named = lists.where("open").select("key", "sid", "n", "pos").join(sized(labels, BROADCAST_ROWS), F.col("sid") == F.col("node"), "left").withColumn("up", F.coalesce("up", "sid")).drop("node")
    one = Window.partitionBy("key")
    apart = named.withColumn("lo", F.min("up").over(one)).withColumn("hi", F.max("up").over(one)).where("lo <> hi").drop("lo", "hi")
    apart = cut(apart.join(holders.select("sid", *_PARITIES), "sid"))
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent) + 1e-9).cast("int")
    side = lambda x: apart.select("key", *(F.col(c).alias(f"{c}_{x}") for c in ("sid", "n", "pos", "up", *_PARITIES)), (F.explode(F.array(band, band + 1)) if x == "a" else band).alias("band"))
    smaller = F.struct("n_a", "sid_a") < F.struct("n_b", "sid_b")
    x, y = side("a"), side("b")
    on = (x["key"] == y["key"]) & (x["band"] == y["band"]) & smaller & (F.col("up_a") != F.col("up_b")) & _possible(("n_a", "pos_a"), ("n_b", "pos_b"), percent) & _near_parity("_a", "_b", percent)
    more = verified(x.join(y, on).select(*ordered("sid_a", "sid_b")).distinct())
    if not more.isEmpty():
        labels = contracted(labels.select(F.col("node").alias("a"), F.col("up").alias("b")).unionAll(more))
    return None if labels.isEmpty() else labels


def _nodes_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("sid")).unionAll(pairs.select("b"))


def one_of_each(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id, of equal ids that of the smallest hash of the text.

    A row is known by its id and text, so rows with a null or a repeated id are told apart. Null
    ids come last. Rows of the empty set stay, and so does every row that links with nothing. All
    columns are passed on.
    """
    found = _members(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")), shingle, percent)
    tied = stored(found.where("tied").select("group", "doc_id", "row_hash"), "tied")
    me = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_hash")
    first = tied.groupBy("group").agg(F.min(me).alias("first"))
    marked = tied.join(first, "group").withColumn("stays", me.eqNullSafe(F.col("first")))
    goes = cut(marked.where("not stays").select("doc_id", "row_hash").distinct())
    row_hash = F.xxhash64(empty_as(docs["text"]))
    this = lambda rows: docs["doc_id"].cast("long").eqNullSafe(rows["doc_id"]) & (row_hash == rows["row_hash"])
    rest = docs.join(sized(goes, BROADCAST_ROWS), this(goes), "left_anti")
    # equal rows of one component: one of them is enough
    twice = cut(marked.where("stays").groupBy("doc_id", "row_hash").agg(F.count("*").alias("k")).where("k > 1").select("doc_id", "row_hash"))
    if not twice.limit(1).count():
        return rest
    few = sized(twice, BROADCAST_ROWS)
    return rest.join(few, this(few), "left_anti").unionByName(rest.join(few, this(few), "left_semi").dropDuplicates(["doc_id", "text"]))
