"""Packing of tokenized documents into fixed windows by multiway differencing.

Each task takes its documents as they come, in blocks of a bounded number. Of a
document's ids, every full window's worth fills a window alone; what remains is cut into
parts of at most ``max_part`` ids. The parts of a block are divided by Karmarkar-Karp
differencing: the two partial partitions with the largest spread are merged with their
imbalances opposed, again and again, which leaves windows of nearly the same size. The
number of windows starts at the least possible one and rises while any window is over
capacity. Nothing is shuffled, so no key can be hot, and a task that is run again packs the
rows that it reads by itself.
"""

from __future__ import annotations

import base64
import heapq
import re
import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import arrow_map, slices, texts_of

WINDOW = 1024
BLOCK = 128
MAX_PART = 256
SEPARATOR = 0

#: Letters on which the two libraries' character classes are known to agree, and nothing else.
_PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-\xac\xae-ſ]*")
_SPECIAL = "<|endoftext|>"


def _file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids as ``tokenizers`` gives them with ``add_special_tokens=False``.

    Where a text has only letters on which both libraries agree and no special token, the
    rank file of the same vocabulary gives the same ids some four times faster.
    """

    def __init__(self, json_path: str | None = None, ranks_path: str | None = None):
        import public_tokenizers
        import tiktoken

        with open(ranks_path or _file("byte_bpe_50k.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self._fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._path, self._slow = json_path or _file("byte_bpe_50k.json"), None

    def ids(self, text: str) -> list[int]:
        if _PLAIN.fullmatch(text) and _SPECIAL not in text:
            return self._fast.encode_ordinary(text)
        if self._slow is None:
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_file(self._path)
        return self._slow.encode(text, add_special_tokens=False).ids


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """``sizes`` divided into ``k`` nearly equal groups, as lists of indices."""
    heap = []
    for i, size in enumerate(sizes):
        sums = np.zeros(k, dtype=np.int64)
        sums[0] = size
        heap.append((-size, i, sums, [[i]] + [[] for _ in range(k - 1)]))
    heapq.heapify(heap)
    serial = len(sizes)
    while len(heap) > 1:
        _, _, a, in_a = heapq.heappop(heap)
        _, _, b, in_b = heapq.heappop(heap)
        sums = a + b[::-1]
        in_b.reverse()
        order = np.argsort(-sums, kind="stable")
        groups = [in_a[j] + in_b[j] for j in order.tolist()]
        sums = sums[order]
        sums -= sums[-1]
        heapq.heappush(heap, (-int(sums[0]), serial, sums, groups))
        serial += 1
    return heap[0][3] if heap else [[] for _ in range(k)]


def fill(sizes: list[int], window: int) -> list[list[int]]:
    """Groups of at most ``window`` each, from the least number of groups upwards."""
    k = -(-sum(sizes) // window)
    while k:
        groups = differencing(sizes, k)
        if max(sum(sizes[i] for i in g) for g in groups) <= window:
            return groups
        k += 1
    return []


def pack_block(tokens: list[np.ndarray], window: int = WINDOW, max_part: int = MAX_PART) -> list[list[tuple[int, int, int]]]:
    """Windows of (document's index, start, length)."""
    windows, parts = [], []
    for d, ids in enumerate(tokens):
        at, n = 0, len(ids)
        while n - at >= window:
            windows.append([(d, at, window)])
            at += window
        while at < n:
            size = min(max_part, n - at)
            parts.append((d, at, size))
            at += size
    windows.extend([parts[i] for i in sorted(g)] for g in fill([p[2] for p in parts], window) if g)
    return windows


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, doc_row long, sequence_tokens int, padded_to int"


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, block: int = BLOCK, max_part: int = MAX_PART, with_ids: bool = False) -> DataFrame:
    """One row for each piece of a document: where it lies in its document and in its sequence.

    A document is its ids and then id 0, so a null or empty text is one id. Rows with the same
    or a null ``doc_id`` are packed each by itself (``doc_row`` tells them apart: the row's number
    in its task, joined to the task's). ``sequence_id`` is unique over all tasks. A sequence is
    padded to the window, unless its tokens are a power of two (``padded_to``). Columns other than
    the two named are not read. With ``with_ids`` a column ``ids`` holds each piece's ids.
    """
    if not 0 < max_part <= window:
        raise ValueError("max_part must be between 1 and the window")
    schema = SCHEMA + (", ids array<int>" if with_ids else "")

    def make():
        encoder = Encoder()
        base = TaskContext.get().partitionId() << 32
        held: list[tuple[int | None, np.ndarray]] = []
        made = {"sequence": 0, "row": 0}

        def flush():
            tokens = [x for _, x in held]
            out: dict[str, list] = {name: [] for name in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "doc_row", "sequence_tokens", "padded_to", "ids")}
            for pieces in pack_block(tokens, window, max_part):
                offset, total = 0, sum(size for _, _, size in pieces)
                for d, start, size in pieces:
                    ids = tokens[d][start : start + size]
                    row = (held[d][0], start, size, zlib.crc32(ids.tobytes()), len(tokens[d]), base + made["sequence"], offset, base + made["row"] + d, total, total if total & (total - 1) == 0 else window, ids.astype(np.int32) if with_ids else None)
                    for column, value in zip(out.values(), row, strict=True):
                        column.append(value)
                    offset += size
                made["sequence"] += 1
            made["row"] += len(held)
            held.clear()
            return out

        def step(batch):
            if batch is None:
                if held:
                    yield flush()
                return
            for part in slices(batch, block):
                for doc_id, text in zip(part.column(0).to_pylist(), texts_of(part), strict=True):
                    ids = encoder.ids(text)
                    ids.append(SEPARATOR)
                    held.append((doc_id, np.array(ids, dtype="<u4")))
                    if len(held) == block:
                        yield flush()

        return step

    return arrow_map(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")), make, schema)
