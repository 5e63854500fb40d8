"""ISO base media containers: writing, walking boxes, and reading sample tables.

A text's UTF-8 bytes become the frames of an uncompressed 8-bit grey video track.
``describe`` never touches the frames: it walks the nested boxes, decodes the sample
tables, and returns codec, duration and the byte range of every keyframe. ``payload``
follows the same tables to the frames' bytes.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from .common import arrow_map, slices, texts_of

WIDTH, HEIGHT = 16, 12
FRAME = WIDTH * HEIGHT
KEYFRAME_EVERY = 12
FRAMES_IN_CHUNK = 64
TIMESCALE = 25

#: Boxes that hold only other boxes.
CONTAINERS = frozenset((b"moov", b"trak", b"edts", b"mdia", b"minf", b"dinf", b"stbl", b"mvex", b"moof", b"traf", b"udta"))


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 > 0xFFFFFFFF:
        return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body
    return struct.pack(">I4s", len(body) + 8, kind) + body


def full_box(kind: bytes, flags: int, *parts: bytes, version: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


_MATRIX = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
_FTYP = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"iso2")
_STSD = full_box(
    b"stsd", 0, struct.pack(">I", 1),
    box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", WIDTH, HEIGHT, 0x480000, 0x480000, 0, 1), bytes(32), struct.pack(">Hh", 40, -1)),
)
_DINF = box(b"dinf", full_box(b"dref", 0, struct.pack(">I", 1), full_box(b"url ", 1)))
_HDLR = full_box(b"hdlr", 0, bytes(4), b"vide", bytes(12), b"frames\0")
_VMHD = full_box(b"vmhd", 1, bytes(8))
_BUILT: dict[int, bytes] = {}


def pad(data: bytes) -> bytes:
    """``data`` with bytes 32 appended, up to a positive multiple of the frame size."""
    return data + b" " * (FRAME - len(data) if not data else -len(data) % FRAME)


def write(frames: bytes) -> bytes:
    """A container whose video track holds ``frames`` (a positive multiple of 192 bytes)."""
    n = len(frames) // FRAME
    if not n or n * FRAME != len(frames):
        raise ValueError("frames must be a positive multiple of the frame size")
    head = _BUILT.get(n)
    if head is None:
        head = _head(n)
        if len(_BUILT) < 4096:
            _BUILT[n] = head
    return head + frames


def _head(n: int) -> bytes:
    """Everything before the frames: it depends on their number alone."""
    chunks = -(-n // FRAMES_IN_CHUNK)
    last = n - (chunks - 1) * FRAMES_IN_CHUNK
    runs = [(1, FRAMES_IN_CHUNK, 1)] if last == FRAMES_IN_CHUNK else [(1, FRAMES_IN_CHUNK, 1), (chunks, last, 1)] if chunks > 1 else [(1, last, 1)]
    keys = range(1, n + 1, KEYFRAME_EVERY)
    wide = n * FRAME + 64 * chunks + 65_536 > 0xFFFFFFFF

    def moov(first: int) -> bytes:
        offsets = [first + i * FRAMES_IN_CHUNK * FRAME for i in range(chunks)]
        table = full_box(b"co64" if wide else b"stco", 0, struct.pack(">I", chunks), struct.pack(f">{chunks}{'Q' if wide else 'I'}", *offsets))
        stbl = box(
            b"stbl",
            _STSD,
            full_box(b"stts", 0, struct.pack(">III", 1, n, 1)),
            full_box(b"stsc", 0, struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            full_box(b"stsz", 0, struct.pack(">II", FRAME, n)),
            table,
            full_box(b"stss", 0, struct.pack(">I", len(keys)), struct.pack(f">{len(keys)}I", *keys)),
        )
        mdhd = full_box(b"mdhd", 0, struct.pack(">IIIIHH", 0, 0, TIMESCALE, n, 0x55C4, 0))
        tkhd = full_box(b"tkhd", 3, struct.pack(">IIIII", 0, 0, 1, 0, n), bytes(8), struct.pack(">hhhH", 0, 0, 0, 0), _MATRIX, struct.pack(">II", WIDTH << 16, HEIGHT << 16))
        mvhd = full_box(b"mvhd", 0, struct.pack(">IIII", 0, 0, TIMESCALE, n), struct.pack(">IHH", 0x10000, 0x100, 0), bytes(8), _MATRIX, bytes(24), struct.pack(">I", 2))
        return box(b"moov", mvhd, box(b"trak", tkhd, box(b"mdia", mdhd, _HDLR, box(b"minf", _VMHD, _DINF, stbl))))

    mdat = struct.pack(">I4sQ", 1, b"mdat", n * FRAME + 16) if n * FRAME + 8 > 0xFFFFFFFF else struct.pack(">I4s", n * FRAME + 8, b"mdat")
    first = len(_FTYP) + len(moov(0)) + len(mdat)
    return _FTYP + moov(first) + mdat


def walk(data: bytes, start: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """Every box, outer before inner: its path, and where its body starts and ends.

    A size of 1 means that 64 bits follow; a size of 0 reaches to the end. A box that
    claims more than its parent holds raises ``ValueError``.
    """
    end = len(data) if end is None else end
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        stop = end if size == 0 else start + size
        if stop > end or stop < body:
            raise ValueError(f"box {kind!r} at {start} does not fit")
        yield (*path, kind), body, stop
        if kind in CONTAINERS:
            yield from walk(data, body, stop, (*path, kind))
        start = stop


def _table(data: bytes, at: int, columns: int, kind: str = ">u4") -> np.ndarray:
    (n,) = struct.unpack_from(">I", data, at + 4)
    return np.frombuffer(data, dtype=kind, count=n * columns, offset=at + 8).astype(np.int64).reshape(n, columns)


def tracks(data: bytes) -> list[dict]:
    """One dictionary for each track: codec, timescale, duration, and each sample's offset, size and whether it is a keyframe."""
    found: list[dict] = []
    for path, body, _ in walk(data):
        name = path[-1]
        if name == b"trak":
            found.append({})
        elif found and path[:2] == (b"moov", b"trak"):
            found[-1][name] = body
    out = []
    for t in found:
        if b"stbl" not in t:
            continue
        version = data[t[b"mdhd"]]
        timescale, duration = struct.unpack_from(">IQ" if version else ">II", data, t[b"mdhd"] + (20 if version else 12))
        codec = data[t[b"stsd"] + 12 : t[b"stsd"] + 16].decode("latin-1")
        fixed, n = struct.unpack_from(">II", data, t[b"stsz"] + 4)
        sizes = np.full(n, fixed, dtype=np.int64) if fixed else np.frombuffer(data, dtype=">u4", count=n, offset=t[b"stsz"] + 12).astype(np.int64)
        chunks = _table(data, t[b"co64"], 1, ">u8")[:, 0] if b"co64" in t else _table(data, t[b"stco"], 1)[:, 0]
        runs = _table(data, t[b"stsc"], 3)
        until = np.append(runs[1:, 0], len(chunks) + 1)
        in_chunk = np.repeat(runs[:, 1], until - runs[:, 0])
        chunk_of = np.repeat(np.arange(len(chunks)), in_chunk)[:n]
        before = np.cumsum(sizes) - sizes
        first = np.cumsum(in_chunk) - in_chunk
        offsets = chunks[chunk_of] + before - before[first[chunk_of]]
        ticks = _table(data, t[b"stts"], 2)
        key = np.ones(n, dtype=bool)
        if b"stss" in t:
            key[:] = False
            key[_table(data, t[b"stss"], 1)[:, 0] - 1] = True
        out.append({"codec": codec, "timescale": timescale, "duration": duration, "ticks": int((ticks[:, 0] * ticks[:, 1]).sum()), "offsets": offsets, "sizes": sizes, "key": key})
    return out


def describe(data: bytes) -> dict:
    """Codec, timescale, duration, number of samples and keyframe byte ranges [start, end) of the first track; the samples' bytes are not read."""
    found = tracks(data)
    if not found:
        return {"codec": None, "timescale": None, "duration": None, "samples": 0, "keyframes": []}
    t = found[0]
    starts, ends = t["offsets"][t["key"]], (t["offsets"] + t["sizes"])[t["key"]]
    return {"codec": t["codec"], "timescale": t["timescale"], "duration": t["duration"], "samples": len(t["sizes"]), "keyframes": list(zip(starts.tolist(), ends.tolist(), strict=True))}


def payload(data: bytes) -> bytes:
    """The first track's samples, in order, found by its tables."""
    t = tracks(data)[0]
    offsets, ends = t["offsets"], t["offsets"] + t["sizes"]
    new = np.flatnonzero(np.append(True, offsets[1:] != ends[:-1]))  # where a sample does not follow the one before
    return b"".join(data[a:b] for a, b in zip(offsets[new].tolist(), ends[np.append(new[1:], len(ends)) - 1].tolist(), strict=True))


def feature(d: dict) -> str:
    """``describe``'s result as one line of text."""
    return f"codec={d['codec'].strip()};timescale={d['timescale']};duration={d['duration']};samples={d['samples']};keyframes=" + ",".join(f"{a}-{b}" for a, b in d["keyframes"])


SCHEMA = "doc_id long, media binary, codec string, timescale long, duration long, samples long, keyframes array<struct<start:long,stop:long>>"


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text as a container, with the columns that ``describe`` reads from it.

    A null text is the empty one: a single frame of blanks. Null ids and repeated rows pass
    through; columns other than the two named are not read, so their names cannot clash.
    """

    def make():
        def step(batch):
            for part in slices(batch, 256) if batch is not None else ():
                media = [write(pad(t.encode())) for t in texts_of(part)]
                seen = [describe(m) for m in media]
                yield {"doc_id": part.column(0), "media": media, "keyframes": [[{"start": a, "stop": b} for a, b in d["keyframes"]] for d in seen]} | {k: [d[k] for d in seen] for k in ("codec", "timescale", "duration", "samples")}

        return step

    return arrow_map(_two(docs, id_col, text_col), make, SCHEMA)


def _two(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of each text's container and of the payload read back from it, one row for each row.

    Nulls, empty texts, repeated rows and further columns: as in ``media_column``. A payload
    that is not read back as it was written raises an error.
    """

    def one(text: str) -> tuple:
        raw = text.encode()
        stored = write(pad(raw))
        seen, back = describe(stored), payload(stored)
        if back[: len(raw)] != raw:
            raise ValueError("the payload was not read back as it was stored")
        return len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(seen)

    def make():
        def step(batch):
            for part in slices(batch, 1024) if batch is not None else ():
                rows = list(zip(*map(one, texts_of(part)), strict=True))
                yield {"doc_id": part.column(0)} | dict(zip(("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"), rows, strict=True))

        return step

    return arrow_map(_two(docs, id_col, text_col), make, DIGEST)
