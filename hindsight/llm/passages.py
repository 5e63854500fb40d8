"""Passages that repeat across documents, found through compact windows of token min-hashes.

The tokens of a text are the hashes of its five-word shingles. Under each of several hash
functions the subsequences of a text fall into compact windows: a node c of the text's Cartesian
tree, with the widest bounds l and r between which c holds the minimum. Every subsequence that
contains c within the bounds has c's value as its min-hash, so one row stands for all of them.
Only nodes whose window is as wide as the shortest passage matter: some 2n / t of n.

Windows of equal value are joined to the earliest document that has the value, not to each
other, so the number of joined rows follows the input even where one passage stands in a third
of all documents. Within a document an interval join keeps the collisions of different hash
functions whose windows hold a common subsequence. What is left is verified:
around each collision the words of both texts are compared and extended over equal runs and
any gap that the wanted similarity has room for, and a passage counts if it has ``min_words`` words and its shingles' exact Jaccard
similarity is at least ``percent``.

A frequent phrase can make a document the earliest holder of a value whose passage it does not
have. Windows in no verified passage are therefore joined once more, by the value together with
the ten or twenty words on one side of the node, to the earliest holder of those other than the
one that they were joined to before.

For verification a text is cut into blocks with margins; a block is read where a collision lies
in it. Words are compared by 32 bits of hash,
and shingles by 64.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shingles
from .common import arrow_map, cut, empty_as, sized, slices, stored, texts_of

SHINGLE, PERCENT, MIN_WORDS = 5, 80, 50
HASHES, AGREE = 4, 2
#: How many shingles, end to end, on one side of a node make its surroundings.
AROUND = 2, 4
BLOCK, MARGIN = 256, 112
BROADCAST_ROWS = 250_000
_U = np.uint64
_REACH = (1 << 14) - 1
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def hash_values(tokens: np.ndarray, hashes: int) -> Iterator[np.ndarray]:
    """The tokens' values under each hash function in turn."""
    for seed in np.arange(1, hashes + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15):
        yield shingles.mix(tokens ^ seed)


def _sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """The best of each run of ``width`` along the last axis, from runs of doubled lengths."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = best(x[..., :-step], x[..., step:])
        have += step
    return x


def nodes_of(values: np.ndarray, width: int) -> np.ndarray:
    """Which positions hold the minimum of some run of ``width`` (rows are hash functions).

    Every run that contains a position has a minimum no greater than the position's value, so
    it is the minimum of one of them if the greatest of those minima is its value.
    """
    least = _sliding(values, width, np.minimum)
    pad = np.zeros((values.shape[0], width - 1), dtype=values.dtype)
    return _sliding(np.concatenate([pad, least, pad], axis=1), width, np.maximum) == values


def compact_windows(values: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """(l, c, r), inclusive, of the nodes of the values' Cartesian tree whose window is at least ``width`` wide.

    Such nodes are minima of runs of that width. A node's parents have wider windows, so the
    nearest smaller values to either side are among those positions. Of equal values the leftmost
    is the smallest.
    """
    if len(values) < width:
        return []
    nodes = np.flatnonzero(nodes_of(values[None, :], width)[0])
    left, right = _bounds(nodes.tolist(), values[nodes].tolist(), len(values))
    return [(a, c, b) for a, c, b in zip(left, nodes.tolist(), right, strict=True) if b - a + 1 >= width]


def _bounds(nodes: list[int], values: list[int], m: int) -> tuple[list[int], list[int]]:
    left, right, stack = [0] * len(nodes), [m - 1] * len(nodes), []
    for i, v in enumerate(values):
        while stack and values[stack[-1]] > v:
            right[stack.pop()] = nodes[i] - 1
        if stack:
            left[i] = nodes[stack[-1]] + 1
        stack.append(i)
    return left, right


def _pack(left: np.ndarray, nodes: np.ndarray, right: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Node, reach to both sides and hash function in 63 bits; a reach beyond 2**14 tokens is cut, which still covers every verified block."""
    return nodes << 32 | np.minimum(nodes - left, _REACH) << 18 | np.minimum(right - nodes, _REACH) << 4 | f


def _unpack(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    c = x >> 32
    return c - (x >> 18 & _REACH), c, c + (x >> 4 & _REACH), x & 15


def surroundings(tokens: np.ndarray, nodes: np.ndarray, begins: np.ndarray | int = 0, ends: np.ndarray | int | None = None) -> np.ndarray:
    """Four times 16 bits for each node: the shingles to its left and to its right as far as each of ``AROUND``; 0 where the text ends before.

    ``begins`` and ``ends`` bound each node's text where ``tokens`` are those of several.
    """
    ends = len(tokens) if ends is None else ends
    out = np.zeros(len(nodes), dtype=np.uint64)
    shift = 0
    for sign in (-1, 1):
        x = np.zeros(len(nodes), dtype=np.uint64)
        for n in range(1, max(AROUND) + 1):
            at = nodes + sign * n * SHINGLE
            inside = (at >= begins) & (at < ends)
            x = shingles.mix(x ^ tokens[np.where(inside, at, 0)])
            if n in AROUND:
                out |= np.where(inside, x >> _U(48) | _U(1), _U(0)) << _U(shift)
                shift += 16
    return out.view(np.int64)


def windows_of(texts: list[np.ndarray], hashes: int, width: int) -> tuple[np.ndarray, ...]:
    """Of many texts' tokens, each at least ``width`` long, the compact windows: the text's number, its node's value, the packed window and the surroundings.

    The texts stand end to end. A run of ``width`` that reaches into the next one counts for nothing.
    """
    tokens = np.concatenate(texts)
    sizes = np.array([len(x) for x in texts])
    ends = np.cumsum(sizes)
    begins = ends - sizes
    across = (ends[:-1, None] - np.arange(1, width)).ravel()
    numbers, keys, packed, places = [], [], [], []
    for f, values in enumerate(hash_values(tokens, hashes)):
        least = _sliding(values, width, np.minimum)
        least[across] = 0
        pad = np.zeros(width - 1, dtype=values.dtype)
        at = np.flatnonzero(_sliding(np.concatenate([pad, least, pad]), width, np.maximum) == values)
        own = values[at]
        cuts = np.searchsorted(at, begins).tolist() + [len(at)]
        number = np.repeat(np.arange(len(texts)), np.diff(cuts))
        nodes = at - begins[number]
        left, right, listed, held = [], [], nodes.tolist(), own.tolist()
        for a, b, m in zip(cuts[:-1], cuts[1:], sizes.tolist(), strict=True):
            x, y = _bounds(listed[a:b], held[a:b], m)
            left += x
            right += y
        left, right = np.array(left), np.array(right)
        wide = right - left + 1 >= width
        numbers.append(number[wide])
        keys.append(own[wide])
        packed.append(_pack(left, nodes, right, f)[wide])
        places.append(at[wide])
    number, place = np.concatenate(numbers), np.concatenate(places)
    return number, np.concatenate(keys).view(np.int64), np.concatenate(packed), surroundings(tokens, place, begins[number], ends[number])


def _window_rows(docs: DataFrame, hashes: int, width: int) -> DataFrame:
    def make():
        def step(batch):
            for part, texts in shingles.runs(batch) if batch is not None else ():
                long = [(rid, tokens) for rid, tokens in zip(part.column(0).to_pylist(), shingles.sequences(texts, SHINGLE), strict=True) if len(tokens) >= width]
                if long:
                    number, keys, packed, around = windows_of([tokens for _, tokens in long], hashes, width)
                    yield {"key": pa.array(keys), "rid": pa.array(np.array([rid for rid, _ in long], dtype=np.int64)[number]), "window": pa.array(packed), "around": pa.array(around)}

        return step

    return arrow_map(docs, make, "key long, rid long, window long, around long")


def supported(a: list, ca: list, lb: list, cb: list, rb: list, f: list, width: int, agree: int = AGREE) -> list[tuple[int, int, int]]:
    """Of a document's collisions the places (source, cA, cB) that ``agree`` hash functions support, thinned to one for each stretch of a diagonal.

    The arguments are lists in the order of cB. Two collisions support each other if a subsequence of
    ``width`` tokens lies in both of their windows and contains both nodes. Their sources may differ:
    where copies vary, the earliest holder of a value is not the same for every hash function.
    """
    n = len(cb)
    kept: list[tuple[int, int, int]] = []
    last: dict[tuple[int, int], int] = {}
    for i in range(n):
        b = cb[i]
        line = (a[i], b - ca[i])
        if last.get(line, -BLOCK) > b - width // 2:
            continue
        functions = {f[i]}
        for step in (1, -1):
            j = i + step
            while 0 <= j < n and len(functions) < agree and abs(cb[j] - b) <= 4 * width:
                if f[j] not in functions:
                    x, y = max(lb[i], lb[j]), min(rb[i], rb[j])
                    if x <= min(b, cb[j]) and y >= max(b, cb[j]) and y - x + 1 >= width:
                        functions.add(f[j])
                j += step
        if len(functions) >= agree:
            kept.append((a[i], ca[i], b))
            last[line] = b
    return kept


def _candidates(hits: DataFrame, width: int, agree: int) -> DataFrame:
    """Places to verify, by block in both texts, from each document's collisions."""

    def make():
        def step(batch):
            if batch is None or not batch.num_rows:
                return
            own = batch.column(1)
            counts = own.value_lengths().to_numpy()
            flat = own.flatten()
            a, wa, wb = (flat.field(i).to_numpy() for i in range(3))
            order = np.lexsort((a, wa, wb, np.repeat(np.arange(len(counts)), counts)))  # a packed window begins with its node
            left, node, right, f = _unpack(wb[order])
            columns = [c.tolist() for c in (a[order], _unpack(wa[order])[1], left, node, right, f)]
            ends = np.concatenate(([0], np.cumsum(counts))).tolist()
            out: dict[str, list] = {k: [] for k in ("a", "a_block", "b", "b_block", "at")}
            for n, b in enumerate(batch.column(0).to_pylist()):
                blocks: dict[tuple[int, int, int], list[int]] = {}
                for source, i, j in supported(*(c[ends[n] : ends[n + 1]] for c in columns), width, agree):
                    blocks.setdefault((source, i // BLOCK, j // BLOCK), []).append(i << 32 | j)
                for (source, x, y), at in blocks.items():
                    for column, value in zip(out.values(), (source, x, b, y, at), strict=True):
                        column.append(value)
            yield out

        return step

    return arrow_map(hits.select("b", "hits"), make, "a long, a_block int, b long, b_block int, at array<long>")


def _blocks(docs: DataFrame) -> DataFrame:
    """The blocks that are asked for (column ``blocks``), with margins."""

    def make():
        def step(batch):
            for part, texts in shingles.runs(batch) if batch is not None else ():
                rids, numbers, data = [], [], []
                hashes, begins = shingles.word_hashes(texts)
                hashes = (hashes >> _U(32)).astype(np.uint32)
                for i, (rid, blocks) in enumerate(zip(part.column(0).to_pylist(), part.column(2).to_pylist(), strict=True)):
                    words = hashes[begins[i] : begins[i + 1]]
                    for n in blocks:
                        rids.append(rid)
                        numbers.append(n)
                        data.append(words[max(0, n * BLOCK - MARGIN) : (n + 1) * BLOCK + MARGIN].tobytes())
                yield {"rid": rids, "block": numbers, "words": data}

        return step

    return arrow_map(docs.select("rid", "text", "blocks"), make, "rid long, block int, words binary")


def _runs(x: "Side", y: "Side", i: int, j: int, most: int) -> list[tuple[int, int, int]]:
    """Equal runs (i, j, length) from x[i] and y[j] onwards, over small edits and gaps of at most ``most`` words on both sides together."""
    out = []
    p, q = x.list, y.list
    while True:
        n = min(len(p) - i, len(q) - j)
        if n > 0:
            other = x.words[i : i + n] != y.words[j : j + n]
            k = int(other.argmax())
            k = k if other[k] else n
            if k:
                out.append((i, j, k))
                i, j = i + k, j + k
        near = () if set(p[i : i + 4]).isdisjoint(q[j : j + 4]) else _EDITS
        for a, b in near:
            if i + a + 3 <= len(p) and j + b + 3 <= len(q) and p[i + a] == q[j + b] and p[i + a : i + a + 3] == q[j + b : j + b + 3]:
                break
        else:
            gap = _gap(x.grams, y.grams, i, j, most)
            if gap is None:
                return out
            a, b = gap
        i, j = i + a, j + b


def _gap(p: list[int], q: list[int], i: int, j: int, most: int) -> tuple[int, int] | None:
    """The words to leave out of either side before the next equal shingle of ``p`` and ``q``, the fewest together; None if they are more than ``most``."""
    x, y = p[i : i + most + 1], q[j : j + most + 1]
    if most < 0 or set(x).isdisjoint(y):
        return None
    at = dict(zip(reversed(y), range(len(y) - 1, -1, -1), strict=True))
    best = None
    for a, gram in enumerate(x):
        if best is not None and a >= sum(best):
            break
        b = at.get(gram)
        if b is not None and a + b <= most and (best is None or (a + b, abs(a - b)) < (sum(best), abs(best[0] - best[1]))):
            best = a, b
    return best


#: Words left out on either side of an edit, the smallest edits first.
_EDITS = sorted(((a, b) for a in range(4) for b in range(4) if a + b), key=lambda e: (e[0] + e[1], abs(e[0] - e[1])))


def _similar(x: list[int], y: list[int]) -> float:
    """Jaccard similarity of two passages by their shingles."""
    a, b = set(x), set(y)
    return len(a & b) / len(a | b)


class Side:
    """Words as an array and as a list, and the hashes of their shingles."""

    def __init__(self, words: np.ndarray, grams: list[int]):
        self.words, self.list, self.grams = words, words.tolist(), grams


class Block:
    """Words of a block, forwards and backwards."""

    def __init__(self, words: np.ndarray):
        n = max(0, len(words) - SHINGLE + 1)
        grams = np.zeros(n, dtype=np.uint64)
        for k in range(SHINGLE):
            grams = grams * _U(0x9E3779B97F4A7C15) + words[k : k + n]
        grams = grams.tolist()
        self.forth, self.back = Side(words, grams), Side(words[::-1], grams[::-1])


def verify(x: Block, y: Block, i: int, j: int, min_words: int = MIN_WORDS, percent: int = PERCENT) -> tuple[int, int, int, int] | None:
    """The longest passage through the equal shingle at x[i], y[j]: (start, stop) in x, then in y; None if none is long and similar enough.

    Passages begin and end with equal runs. The shingles of the runs alone are shared for certain;
    where they make up the wanted similarity, it is counted exactly.
    """
    p, q = x.forth.list, y.forth.list
    if p[i : i + SHINGLE] != q[j : j + SHINGLE]:
        return None
    n, m = len(p), len(q)
    # a gap of so many words leaves SHINGLE - 1 more shingles unshared on either side
    most = (min(n, m) - SHINGLE + 1) * (100 - percent) // percent - 2 * (SHINGLE - 1)
    back = _runs(x.back, y.back, n - i - SHINGLE, m - j - SHINGLE, most)
    forth = _runs(x.forth, y.forth, i, j, most)
    if n - back[-1][0] - back[-1][2] + min_words > forth[-1][0] + forth[-1][2]:
        return None
    runs = [(n - a - k, m - b - k, k) for a, b, k in reversed(back)]
    a, b, _ = runs[-1]
    here = len(runs) - 1
    runs[-1] = (a, b, forth[0][0] + forth[0][2] - a)  # the shingle's own run belongs to both directions
    runs += forth[1:]
    before = [0]
    for _, _, k in runs:
        before.append(before[-1] + max(0, k - SHINGLE + 1))
    spans = sorted(((runs[e][0] + runs[e][2] - runs[s][0], s, e) for s in range(here + 1) for e in range(here, len(runs))), reverse=True)
    for length, s, e in spans:
        if length < min_words:
            return None
        x0, y0, x1, y1 = runs[s][0], runs[s][1], runs[e][0] + runs[e][2], runs[e][1] + runs[e][2]
        if y1 - y0 < min_words:
            continue
        if s == e:
            return x0, x1, y0, y1
        shared = before[e + 1] - before[s]
        union = x1 - x0 + y1 - y0 - 2 * SHINGLE + 2 - shared
        if 100 * shared >= percent * union and 100 * _similar(x.forth.grams[x0 : x1 - SHINGLE + 1], y.forth.grams[y0 : y1 - SHINGLE + 1]) >= percent:
            return x0, x1, y0, y1
    return None


def _passages(rows: DataFrame, min_words: int, percent: int) -> DataFrame:
    def make():
        def step(batch):
            if batch is None:
                return
            out: dict[str, list] = {k: [] for k in ("a", "b", "a_start", "start", "stop")}
            columns = [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("a", "a_block", "b", "b_block", "at", "x", "y")]
            for a, a_block, b, b_block, at, x, y in zip(*columns, strict=True):
                x, y = Block(np.frombuffer(x, np.uint32)), Block(np.frombuffer(y, np.uint32))
                x0, y0 = max(0, a_block * BLOCK - MARGIN), max(0, b_block * BLOCK - MARGIN)
                done: list[tuple[int, int, int]] = []
                for place in at:
                    i, j = (place >> 32) - x0, (place & 0xFFFFFFFF) - y0
                    if any(s <= j < e and j - i == d for s, e, d in done):
                        continue  # on the diagonal of a passage found already
                    found = verify(x, y, i, j, min_words, percent)
                    if found:
                        done.append((found[2], found[3], j - i))
                        for column, value in zip(out.values(), (a, b, found[0] + x0, found[2] + y0, found[3] + y0), strict=True):
                            column.append(value)
            yield out

        return step

    return arrow_map(rows, make, "a long, b long, a_start int, start int, stop int")


def _identified(docs: DataFrame) -> DataFrame:
    """rid, doc_id and text; ``rid`` is the id, or, where an id is null or stands on several rows, a hash of id and text."""
    twice = cut(docs.groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1 or doc_id is null").select(F.col("doc_id").alias("again")))
    if not twice.limit(1).count():
        return docs.select(F.col("doc_id").alias("rid"), "doc_id", "text")
    marked = docs.join(sized(twice.withColumn("marked", F.lit(True)), BROADCAST_ROWS), docs["doc_id"].eqNullSafe(F.col("again")), "left")
    return marked.select(F.when(F.col("marked"), F.xxhash64(F.coalesce("doc_id", F.lit(-1)), empty_as(F.col("text")))).otherwise(F.col("doc_id")).alias("rid"), "doc_id", "text")


def _shared(windows: DataFrame) -> DataFrame:
    """Rows of ``windows`` whose key stands in two documents, with the first of them (a)."""
    one = Window.partitionBy("key")
    return windows.withColumn("a", F.min("rid").over(one)).withColumn("z", F.max("rid").over(one)).where("a <> z").drop("z")


def _first_windows(live: DataFrame) -> DataFrame:
    """``live`` with the first window (wa) of the key's first document."""
    sources = live.where("rid = a").groupBy("key").agg(F.min("window").alias("wa"))
    return live.join(sources, "key")


def _open(live: DataFrame, found: DataFrame) -> DataFrame:
    """Windows by their value and surroundings, of those that were joined in vain: their node is in no passage found in their document."""
    spans = cut(found.groupBy(F.col("b").alias("rid")).agg(_merge_spans_of()))
    left = live.where("rid <> a or window <> wa").join(sized(spans, BROADCAST_ROWS // 2), "rid", "left")
    node = F.shiftright("window", 32)
    left = left.where(~F.coalesce(F.exists("spans", lambda s: (s["start"] <= node) & (node + SHINGLE <= s["stop"])), F.lit(False)))
    parts = [(i, F.shiftrightunsigned("around", 16 * i).bitwiseAND(0xFFFF)) for i in range(2 * len(AROUND))]
    keys = F.array_compact(F.array(*[F.when(part != 0, F.xxhash64("key", F.lit(i), part)) for i, part in parts]))
    return left.select(F.explode(keys).alias("key"), "rid", "window")


def _found(docs: DataFrame, min_words: int, percent: int, hashes: int, agree: int) -> DataFrame:
    """Verified passages: source a, document b, and where they start (and stop in b), in words. ``docs`` has rid and text."""
    width = min_words - SHINGLE + 1
    live = _first_windows(stored(_shared(_window_rows(docs, hashes, width)), "windows"))
    found = cut(_verified(docs, live, min_words, percent, agree))
    left = stored(_open(live, found), "open")
    further = _first_windows(_shared(left))
    return found.unionAll(_verified(docs, further, min_words, percent, agree))


def _verified(docs: DataFrame, live: DataFrame, min_words: int, percent: int, agree: int) -> DataFrame:
    """Passages at the collisions of ``live`` windows with their first holders."""
    width = min_words - SHINGLE + 1
    hits = live.where("rid <> a").groupBy(F.col("rid").alias("b")).agg(F.collect_set(F.struct("a", "wa", F.col("window").alias("wb"))).alias("hits"))
    places = stored(_candidates(hits, width, agree), "places")
    asked = places.select(F.col("a").alias("rid"), F.col("a_block").alias("block")).unionAll(places.select("b", "b_block")).distinct()
    asked = cut(asked.groupBy("rid").agg(F.collect_list("block").alias("blocks")))
    wanted = F.broadcast(asked) if asked.count() <= BROADCAST_ROWS // 2 else asked
    blocks = stored(_blocks(docs.join(wanted, "rid")).dropDuplicates(["rid", "block"]), "blocks")
    both = places.join(blocks.select(F.col("rid").alias("a"), F.col("block").alias("a_block"), F.col("words").alias("x")), ["a", "a_block"])
    both = both.join(blocks.select(F.col("rid").alias("b"), F.col("block").alias("b_block"), F.col("words").alias("y")), ["b", "b_block"])
    return _passages(both.select("a", "a_block", "b", "b_block", "at", "x", "y"), min_words, percent)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching spans as one."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], stop))
        else:
            out.append((start, stop))
    return out


_SPANS = "array<struct<start:int,stop:int>>"


def _merge_spans(spans: str) -> F.Column:
    """``merged`` as an expression over an array of (start, stop)."""
    return F.aggregate(
        F.array_sort(spans),
        F.array().cast(_SPANS),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (s["start"] <= F.element_at(acc, -1)["stop"]),
            F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["stop"], s["stop"]).alias("stop")))),
        ).otherwise(F.concat(acc, F.array(s))),
    )


def repeats(docs: DataFrame, min_words: int = MIN_WORDS, percent: int = PERCENT, hashes: int = HASHES, agree: int = AGREE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pairs of a document and an earlier one that holds passages of it.

    Rows doc_id, source_id (the smaller id), spans (from and to, in words of doc_id's text) and
    n_words, the words they cover. Each passage is tied to the earliest documents that share its
    min-hashes, or these and the words beside them, not to all that hold it. A passage has at least ``min_words`` words in both texts.

    Null and empty texts and texts that are shorter hold no passage. Rows that agree in id and
    text are one document; rows with a null or repeated id and different texts are compared with
    each other too, in the order of a hash. Columns other than the two named are not read.
    """
    named = _identified(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")))
    found = _found(named.select("rid", "text"), min_words, percent, hashes, agree)
    pairs = found.groupBy("a", "b").agg(_merge_spans_of()).select("a", "b", "spans")
    ids = named.where("rid <> doc_id or doc_id is null").select("rid", F.col("doc_id").alias("own"), F.lit(True).alias("other")).dropDuplicates(["rid"])
    for side, name in (("b", "doc_id"), ("a", "source_id")):
        pairs = pairs.join(ids.withColumnRenamed("rid", side), side, "left").withColumn(name, F.when(F.col("other"), F.col("own")).otherwise(F.col(side))).drop("own", "other")
    return pairs.select("doc_id", "source_id", "spans", F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"]).alias("n_words"))


def _merge_spans_of() -> F.Column:
    return _merge_spans(F.collect_list(F.struct("start", "stop"))).alias("spans")


def drop_repeats(docs: DataFrame, min_words: int = MIN_WORDS, percent: int = PERCENT, hashes: int = HASHES, agree: int = AGREE) -> DataFrame:
    """``docs`` without the passages of ``text`` that an earlier document holds; all other columns and rows as they are.

    A passage goes with the white space behind its last word. Nulls, short texts and repeated ids: as in ``repeats``.
    """
    columns = docs.columns
    named = _identified(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")))
    found = _found(named.select("rid", "text"), min_words, percent, hashes, agree)
    spans = cut(found.groupBy(F.col("b").alias("_rid")).agg(_merge_spans_of().alias("_spans")))
    keyed = docs.withColumn("_id", docs["doc_id"].cast("long")).withColumn("_hash", F.xxhash64(F.coalesce("_id", F.lit(-1)), empty_as(docs["text"])))
    few = F.broadcast if spans.count() <= BROADCAST_ROWS // 2 else (lambda x: x)
    # a hash of id and text never equals another row's id but by chance of 2 ** -64
    by_id = keyed.join(few(spans), F.col("_id") == F.col("_rid"), "left").drop("_rid")
    if named.where("rid <> doc_id or doc_id is null").limit(1).count():
        more = spans.withColumnsRenamed({"_rid": "_rid2", "_spans": "_spans2"})
        by_id = by_id.join(few(more), F.col("_hash") == F.col("_rid2"), "left").withColumn("_spans", F.coalesce("_spans", "_spans2")).drop("_rid2", "_spans2")
    touched = by_id.where("_spans is not null")
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}

    def make():
        def step(batch):
            for part in slices(batch, 512) if batch is not None else ():
                texts = [without(t, [(s["start"], s["stop"]) for s in spans]) for t, spans in zip(texts_of(part), part.column(len(columns)).to_pylist(), strict=True)]
                yield {c: texts if c == "text" else part.column(i) for i, c in enumerate(columns)}

        return step

    changed = arrow_map(touched.select(*columns, "_spans"), make, ", ".join(f"`{c}` {kinds[c]}" for c in columns))
    return by_id.where("_spans is null").select(*columns).unionAll(changed)


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and the white space behind each span."""
    words = list(_WORD.finditer(text))
    out, at = [], 0
    for start, stop in spans:
        out.append(text[at : words[start].start()])
        at = words[stop].start() if stop < len(words) else len(text)
    out.append(text[at:])
    return "".join(out)
