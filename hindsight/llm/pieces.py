"""SentencePiece BPE with seeded merge-dropout, and its decoding.

The merges of a text are taken from an agenda, best piece first and leftmost among equals. Each
candidate that comes up is skipped with a set chance, decided by a hash keyed with the seed, the
row's id, the text and the segment's place in it, so every occurrence draws its own, the same seed
gives the same segmentation on any machine, and another seed another one. Without dropout the ids
are the library's own.

No piece of the vocabulary joins a letter to a following blank mark, nor holds a letter that only
stands alone, so a text falls into segments that never merge with each other, and what a segment
becomes without a skip is kept for the next one like it. What it becomes depends on nothing but which
of its candidates, counted as they come up, are skipped. An occurrence draws the number of candidates
up to its first skip, then up to the next one. Occurrences that skip any, and segments not met before,
are merged many at a time: in each round every one of them takes its next candidate (``_fold``).

Letters outside the vocabulary become byte pieces, and so does a blank mark that the text itself
contains; hence decoding gives back every text exactly. This is checked: each segment's pieces
must spell it when they are made, and a text's segments must make it up; either failing is an error.
``encode`` also decodes each row's ids as a whole and tells whether they give the text.
"""

from __future__ import annotations

import heapq
import re
from array import array
from bisect import bisect_right
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from .common import arrow_map, list_array, slices
from .shingles import mix, runs

BLANK = "▁"
DROPOUT = 0.1
KEPT_SEGMENTS = 400_000
_MASK = (1 << 64) - 1
_NEVER = float("inf")
#: Segments up to this length are merged many at a time, in these classes of length; longer ones one by one.
_SHORT = 40
_CLASSES = (1, 4, 6, 8, 10, 14, _SHORT)
_STEP = 0x9E3779B97F4A7C15
_LEVEL = 0xD1B54A32D192ED03
_U = np.uint64


def _path(path: str | None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pairs:
    """What two neighbouring symbols, by their ids, merge into: a table of slots by hash, and a sorted list of the pairs whose slot was taken."""

    def __init__(self, piece_id: dict[str, int], none: int, bits: int = 20):
        get, found = piece_id.get, []
        for piece, i in piece_id.items():
            for k in range(1, len(piece)):
                a, b = get(piece[:k]), get(piece[k:])
                if a is not None and b is not None:
                    found.append((a, b, i))
        left, right, to = np.array(found, dtype=np.int64).reshape(-1, 3).T
        self.none, self._n, self._shift = none, none + 1, _U(64 - bits)
        pairs = left * self._n + right
        slots = self._slots(pairs)
        _, first = np.unique(slots, return_index=True)
        rest = np.setdiff1d(np.arange(len(pairs)), first)
        rest = rest[np.argsort(pairs[rest])]
        self._pair, self._to, self._over = np.full(1 << bits, -1, np.int64), np.full(1 << bits, none, np.int32), np.zeros(1 << bits, bool)
        self._pair[slots[first]], self._to[slots[first]], self._over[slots[rest]] = pairs[first], to[first], True
        self._more, self._more_to = pairs[rest], to[rest]

    def _slots(self, pairs: np.ndarray) -> np.ndarray:
        return (pairs.view(np.uint64) * _U(_STEP) >> self._shift).view(np.int64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The ids that a and b merge into; ``none`` where they do not."""
        pairs = a.astype(np.int64) * self._n + b
        slots = self._slots(pairs)
        hit = self._pair[slots] == pairs
        out = np.where(hit, self._to[slots], self.none)
        missed = np.flatnonzero(~hit & self._over[slots])
        if len(missed):
            at = np.minimum(np.searchsorted(self._more, pairs[missed]), len(self._more) - 1)
            there = self._more[at] == pairs[missed]
            out[missed[there]] = self._more_to[at[there]]
        return out


class Codec:
    """Encoder and decoder of one model file, seed and chance of dropout."""

    def __init__(self, path: str | None = None, seed: int = 0, dropout: float = DROPOUT, kept: int = KEPT_SEGMENTS):
        import sentencepiece

        if not 0 <= dropout <= 1:
            raise ValueError("dropout must be between 0 and 1")
        model = sentencepiece.SentencePieceProcessor(model_file=_path(path))
        self.bytes_id = [0] * 256
        self.piece_id: dict[str, int] = {}
        self.rank: dict[str, float] = {}
        self.table: list[bytes] = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes_id[int(piece[3:5], 16)] = i
                self.table.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.table.append(b"")
            else:
                self.piece_id[piece] = i
                self.rank[piece] = -model.get_score(i)
                self.table.append(piece.replace(BLANK, " ").encode())
        joined = [p for p in self.piece_id if len(p) > 1]
        if any(BLANK in p.lstrip(BLANK) for p in joined):
            raise ValueError("a piece holds a blank mark behind a letter; texts cannot be cut there")
        letters = "".join(re.escape(c) for c in sorted({c for p in joined for c in p} - {BLANK}))
        self._segments = re.compile(f" *[{letters}]+| +|.", re.S)
        self.seed, self.kept = seed, kept
        # a gap is the number of limits that a hash of 64 bits reaches: it is over k with the chance that k + 1 candidates in a row are kept
        self._limits: list[int] = []
        left, stays = 1 << 64, max(1, (1 << 64) - int(dropout * (1 << 64)))
        while dropout and len(self._limits) < 4096 and (left := left * stays >> 64):
            self._limits.append((1 << 64) - left)
        self._gaps = np.array(self._limits, dtype=np.uint64)
        self._young: dict = {}
        self._old: dict = {}
        none = len(self.table)
        self._pairs = Pairs(self.piece_id, none)
        self._order = np.full(none + 1, np.iinfo(np.int32).max, np.int32)
        ids = np.array([*self.piece_id.values()], dtype=np.int64)
        self._order[ids] = np.unique([self.rank[x] for x in self.piece_id], return_inverse=True)[1]
        self._n_letters = np.zeros(none, np.int64)
        self._n_letters[ids] = [*map(len, self.piece_id)]
        self._letter_id = np.full(0x110000, none, np.int32)
        for piece, i in self.piece_id.items():
            if len(piece) == 1 and piece != BLANK:
                self._letter_id[ord(piece)] = i
        self._letter_id[0x20] = self.piece_id.get(BLANK, none)

    def _draw(self, keys: np.ndarray, level: np.ndarray, at: np.ndarray) -> None:
        """``_next`` for many: ``at`` moves on to the next skip, and ``level`` with it."""
        todo = np.arange(len(keys))
        while len(todo):
            x = mix(keys[todo] + level[todo] * _U(_LEVEL))
            gap = np.searchsorted(self._gaps, x, side="right")
            level[todo] += _U(1)
            at[todo] += gap
            todo = todo[(gap == len(self._limits)) & (at[todo] < 3 * _SHORT)]

    def _fold(self, segments: list[str], keys: np.ndarray | None = None, skip: np.ndarray | None = None) -> tuple[np.ndarray, list[bytes | None]]:
        """``_encode`` for many: how many candidates come up, and the ids; with ``keys`` skipping as these draw, first the candidate ``skip``.

        No ids where a segment is too long or holds a letter that is no piece.
        """
        counts, out = np.zeros(len(segments), np.int64), [None] * len(segments)
        if not segments:
            return counts, out
        none, never, order, pairs = self._pairs.none, np.iinfo(np.int32).max, self._order, self._pairs
        lengths = np.fromiter(map(len, segments), np.int64, len(segments))
        starts = np.cumsum(lengths) - lengths
        letters = self._letter_id[np.frombuffer("".join(segments).encode("utf-32-le"), np.uint32)]
        fit = np.add.reduceat(letters == none, starts) == 0
        for least, width in zip(_CLASSES[:-1], _CLASSES[1:], strict=True):
            rows = np.flatnonzero(fit & (lengths > least) & (lengths <= width))
            if not len(rows):
                continue
            # a symbol stands where its first letter stood; there is a place without one at either end
            n, wide = len(rows), width + 2
            symbol = np.full((n, wide), none, np.int32)
            inside = np.arange(width) < lengths[rows][:, None]
            symbol[:, 1:-1][inside] = letters[(starts[rows][:, None] + np.arange(width))[inside]]
            to = np.full((n, wide), none, np.int32)
            to[:, :-1] = pairs(symbol[:, :-1].ravel(), symbol[:, 1:].ravel()).reshape(n, wide - 1)
            agenda = order[to]
            symbol, to, ranks = symbol.ravel(), to.ravel(), agenda.ravel()
            after, before = np.arange(n * wide) + 1, np.arange(n * wide) - 1
            live, number, count = np.arange(n), 0, np.zeros(n, np.int64)
            if keys is not None:
                own, level, at = keys[rows], np.ones(n, np.uint64), skip[rows].astype(np.int64)
                on = np.flatnonzero(at == len(self._limits))
                if len(on):
                    k, v, a = own[on], level[on], at[on]
                    self._draw(k, v, a)
                    level[on], at[on] = v, a
            while True:
                i = live * wide + agenda[live].argmin(axis=1)
                more = ranks[i] != never
                if not more.all():
                    live, i = live[more], i[more]
                if not len(live):
                    break
                count[live] += 1
                if keys is not None:
                    stop = at[live] == number
                    if stop.any():
                        who = live[stop]
                        ranks[i[stop]] = never
                        k, v, a = own[who], level[who], at[who] + 1
                        self._draw(k, v, a)
                        level[who], at[who] = v, a
                        i = i[~stop]
                j = after[i]
                k, h = after[j], before[i]
                symbol[i], symbol[j], ranks[j] = to[i], none, never
                after[i], before[k] = k, i
                ends = np.concatenate([h, i])
                to[ends] = pairs(symbol[ends], np.concatenate([symbol[i], symbol[k]]))
                ranks[ends] = order[to[ends]]
                number += 1
            counts[rows] = count
            there = symbol != none
            ids, sizes = symbol[there], there.reshape(n, wide).sum(axis=1)
            ends = np.cumsum(sizes)
            took = [segments[x] for x in rows.tolist()]
            if (np.add.reduceat(self._n_letters[ids], ends - sizes) != lengths[rows]).any() or b"".join(map(self.table.__getitem__, ids.tolist())) != "".join(took).encode():
                raise ValueError("a segment does not decode to itself")
            data, begin = ids.tobytes(), 0
            for x, end in zip(rows.tolist(), (4 * ends).tolist(), strict=True):
                out[x], begin = data[begin:end], end
        return counts, out

    def _next(self, key: int, at: int, level: int, stop: int) -> tuple[int, int]:
        """The next skip from candidate ``at`` on, or some number from ``stop`` on, and the next level of ``key``."""
        while at < stop:
            x = (key + level * 0xD1B54A32D192ED03) & _MASK
            x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & _MASK
            x = ((x ^ x >> 27) * 0x94D049BB133111EB) & _MASK
            gap = bisect_right(self._limits, x ^ x >> 31)
            level += 1
            at += gap
            if gap < len(self._limits):  # otherwise as many are kept, and it goes on from there
                break
        return at, level

    def _merge(self, segment: str, skips: tuple[int, ...] | set[int]) -> tuple[list[str], int]:
        """The pieces of a segment after the agenda has run dry, and how many candidates came up; those with the numbers ``skips`` are skipped."""
        return self._short(segment, skips) if len(segment) <= _SHORT else self._long(segment, skips)

    def _short(self, segment: str, skips: tuple[int, ...] | set[int]) -> tuple[list[str], int]:
        """An agenda of so few candidates that a list holds it: by place, with the next one found by its rank."""
        symbols = list(segment)
        get, never, number = self.rank.get, _NEVER, -1
        agenda = [get(x + y, never) for x, y in zip(symbols, symbols[1:])]
        while agenda:
            best = min(agenda)
            if best is never:
                break
            at = agenda.index(best)
            number += 1
            if number in skips:
                agenda[at] = never
                continue
            joined = symbols[at] + symbols[at + 1]
            symbols[at : at + 2] = (joined,)
            del agenda[at]
            if at:
                agenda[at - 1] = get(symbols[at - 1] + joined, never)
            if at < len(agenda):
                agenda[at] = get(joined + symbols[at + 1], never)
        return symbols, number + 1

    def _long(self, segment: str, skips: tuple[int, ...] | set[int]) -> tuple[list[str], int]:
        """The same with a heap."""
        n, rank, number = len(segment), self.rank, -1
        end = list(range(1, n + 1))  # end[i]: where the symbol that starts at i ends; 0: merged away
        before = list(range(-1, n))
        agenda = []
        for i in range(n - 1):
            r = rank.get(segment[i : i + 2])
            if r is not None:
                agenda.append((r, i, i + 1, i + 2))
        heapq.heapify(agenda)
        while agenda:
            _, i, j, k = heapq.heappop(agenda)
            if end[i] != j or end[j] != k:
                continue  # one of the two has grown meanwhile
            number += 1
            if number in skips:
                continue
            end[i], end[j] = k, 0
            if k < n:
                before[k] = i
                r = rank.get(segment[i : end[k]])
                if r is not None:
                    heapq.heappush(agenda, (r, i, k, end[k]))
            h = before[i]
            if h >= 0:
                r = rank.get(segment[h:k])
                if r is not None:
                    heapq.heappush(agenda, (r, h, i, k))
        return [segment[i : end[i]] for i in range(n) if end[i]], number + 1

    def _encode(self, segment: str, skips: tuple[int, ...] | set[int]) -> tuple[int, bytes]:
        if segment == BLANK:  # stands for itself, not for a blank
            count, ids = 0, [self.bytes_id[b] for b in segment.encode()]
        else:
            found, count = self._merge(segment.replace(" ", BLANK), skips)
            ids = [*map(self.piece_id.get, found)]
            if None in ids:
                ids = [x for piece, i in zip(found, ids, strict=True) for x in ([self.bytes_id[b] for b in piece.encode()] if i is None else (i,))]
        if b"".join(map(self.table.__getitem__, ids)) != segment.encode():
            raise ValueError(f"the segment {segment!r} does not decode to itself")
        return count, array("i", ids).tobytes()

    def _look_up(self, segment: str, skips: tuple[int, ...] = ()) -> tuple[int, bytes]:
        """How many candidates come up, and the ids."""
        key = (segment, skips) if skips else segment
        found = self._old.get(key) or self._encode(segment, skips)
        if len(self._young) >= self.kept:  # what was not met since the last turn is forgotten
            self._old, self._young = self._young, {}
        self._young[key] = found
        return found

    def _skipped(self, segment: str, at: int, key: int) -> bytes:
        """The ids of an occurrence that skips candidate ``at`` first."""
        level = 1
        if at == len(self._limits):
            at, level = self._next(key, at, level, 3 * len(segment))
        if len(segment) > _SHORT:
            skips = set()
            while at < 3 * len(segment):  # no more ever come up: one between two letters each, and two behind each merge
                skips.add(at)
                at, level = self._next(key, at + 1, level, 3 * len(segment))
            return self._encode(segment, skips)[1]
        taken, found = (), self._young.get(segment) or self._look_up(segment)
        while at < found[0]:
            taken += (at,)
            found = self._young.get((segment, taken)) or self._look_up(segment, taken)
            at, level = self._next(key, at + 1, level, found[0])
        return found[1]

    def _meet(self, segments: set[str]) -> None:
        """Have what the segments become at hand; what was not met since the last turn is forgotten."""
        new = [x for x in segments if x not in self._young]
        if len(self._young) + len(new) > self.kept:
            self._old, self._young, new = self._young, {}, segments
        old, unknown = self._old.get, []
        for x in new:
            found = old(x)
            if found:
                self._young[x] = found
            else:
                unknown.append(x)
        counts, made = self._fold(unknown)
        for x, count, ids in zip(unknown, counts.tolist(), made, strict=True):
            self._young[x] = (count, ids) if ids is not None else self._encode(x, ())

    def many(self, texts: list[str], keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in order, and how many each text has; a key (an id, say) lets equal texts differ."""
        split = [self._segments.findall(" " + t) if t else [] for t in texts]
        if any(sum(map(len, x)) != len(t) + 1 for x, t in zip(split, texts, strict=True) if t):
            raise ValueError("the segments do not make up the text")
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        segments = [*chain.from_iterable(split)]
        del split
        if not segments:
            return np.zeros(0, dtype=np.int32), np.zeros(len(texts), np.int64)
        self._meet(set(segments))
        found = [*map(self._young.__getitem__, segments)]
        out = [ids for _, ids in found]
        ends = np.cumsum(sizes)
        if self._limits:
            counts = np.fromiter((n for n, _ in found), np.int64, len(found))
            own = np.array([xxhash.xxh64_intdigest(t, xxhash.xxh64_intdigest(k, self.seed & _MASK)) for t, k in zip(texts, keys, strict=True)], dtype=np.uint64)
            place = (np.arange(len(segments)) - np.repeat(ends - sizes, sizes)).astype(np.uint64)
            key = place * _U(_STEP) + np.repeat(own, sizes)
            gaps = np.searchsorted(self._gaps, mix(key), side="right")
            skipping = np.flatnonzero(gaps < counts)
            key, gaps, at = key[skipping], gaps[skipping], skipping.tolist()
            _, made = self._fold([segments[i] for i in at], key, gaps)
            for n, (i, ids) in enumerate(zip(at, made, strict=True)):
                out[i] = ids if ids is not None else self._skipped(segments[i], int(gaps[n]), int(key[n]))
        lengths = np.concatenate([[0], np.cumsum(np.fromiter(map(len, out), np.int64, len(out)) // 4)])
        return np.frombuffer(b"".join(out), dtype=np.int32), lengths[ends] - lengths[ends - sizes]

    def ids(self, text: str, key: str = "") -> np.ndarray:
        """The text's ids."""
        return self.many([text], [key])[0]

    def text(self, ids: np.ndarray | list[int]) -> str:
        """The text of ids; it begins with the blank that encoding has put before it."""
        data = b"".join(map(self.table.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids))
        return data[1:].decode() if data[:1] == b" " else data.decode(errors="replace")


@lru_cache(maxsize=4)
def _codec(path: str | None, seed: int, dropout: float) -> Codec:
    """One for each Python worker, so that what it has kept serves its later tasks too."""
    return Codec(path, seed, dropout)


SCHEMA = "doc_id long, ids array<int>, n_ids long, lossless boolean"


def encode(docs: DataFrame, seed: int = 20240601, dropout: float = DROPOUT, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's ids under merge-dropout, their number, and whether decoding them has given the text back.

    Null and empty texts have no ids. Rows with the same id and text get the same ids; a null id
    is one more id. Columns other than the two named are not read.
    """

    def make():
        codec = _codec(path, seed, dropout)

        def step(batch):
            for part, texts in runs(batch) if batch is not None else ():
                ids, lengths = codec.many(texts, [*map(str, part.column(0).to_pylist())])
                each = np.split(ids, np.cumsum(lengths)[:-1])
                yield {"doc_id": part.column(0), "ids": list_array(ids, lengths, pa.int32()), "n_ids": lengths, "lossless": [codec.text(x) == t for x, t in zip(each, texts, strict=True)]}

        return step

    return arrow_map(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")), make, SCHEMA)


def decode(rows: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of each row's ids; null ids give the empty text."""

    def make():
        codec = _codec(path, 0, 0.0)

        def step(batch):
            for part in slices(batch, 512) if batch is not None else ():
                yield {"doc_id": part.column(0), "text": [codec.text(x or []) for x in part.column(1).to_pylist()]}

        return step

    return arrow_map(rows.select(rows[id_col].cast("long").alias("doc_id"), rows[ids_col].alias("ids")), make, "doc_id long, text string")
