"""ISO media containers: nested boxes, sample tables and keyframe byte ranges.

``store`` writes bytes as one track of unsigned 8-bit samples ("raw "), 64 bytes
to a sample table entry. ``read_media`` walks the boxes of any such file, decodes the
sample tables and the runs of fragments, and returns codec, duration and the byte
range of every keyframe of every track; it never decodes payloads.

Null content or content that is not a well-formed container: the row stays, with
the reason in ``fault`` and null features. Empty content is not well formed; the
empty text is stored as one sample of zeros. Repeated rows: each is returned. A table
may state no more samples than the file can hold, so memory follows the file's length,
however long. Tracks stand in the file's order. An empty table has no rows. Other
columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.textkernel import small

UNIT = 64
RATE = 8000
SAMPLES_IN_CHUNK = 64
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"mvex", b"moof", b"traf"}


class ContainerFault(ValueError):
    pass


def box(kind: bytes, *content: bytes) -> bytes:
    body = b"".join(content)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def full_box(kind: bytes, *content: bytes, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", flags), *content)


def padded(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % UNIT if raw else UNIT)


_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def store(payload: bytes) -> bytes:
    """A file of one sound track that holds the payload, a positive multiple of 64 bytes."""
    n = len(payload) // UNIT
    chunks = -(-n // SAMPLES_IN_CHUNK)
    last = n - (chunks - 1) * SAMPLES_IN_CHUNK
    runs = [(1, SAMPLES_IN_CHUNK, 1)] if chunks > 1 else []
    if chunks == 1 or last != SAMPLES_IN_CHUNK:
        runs.append((chunks, last, 1))
    entry = box(b"raw ", bytes(6), struct.pack(">H8xHHHHI", 1, 1, 8, 0, 0, RATE << 16))
    keys = np.arange(1, n + 1, SAMPLES_IN_CHUNK, dtype=">u4")
    head = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomqt  ")

    def movie(first: int) -> bytes:
        places = first + np.arange(chunks, dtype=np.int64) * (SAMPLES_IN_CHUNK * UNIT)
        wide = chunks and first + len(payload) >= 1 << 32
        table = box(
            b"stbl",
            full_box(b"stsd", struct.pack(">I", 1), entry),
            full_box(b"stts", struct.pack(">III", 1, n, UNIT)),
            full_box(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            full_box(b"stsz", struct.pack(">II", UNIT, n)),
            full_box(b"co64" if wide else b"stco", struct.pack(">I", chunks), places.astype(">u8" if wide else ">u4").tobytes()),
            full_box(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
        )
        reference = box(b"dinf", full_box(b"dref", struct.pack(">I", 1), full_box(b"url ", flags=1)))
        media = box(
            b"mdia",
            full_box(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, len(payload), 0x55C4, 0)),
            full_box(b"hdlr", struct.pack(">I4s12x", 0, b"soun"), b"\0"),
            box(b"minf", full_box(b"smhd", bytes(4)), reference, table),
        )
        track = full_box(b"tkhd", struct.pack(">IIIII8xHHHH", 0, 0, 1, 0, len(payload), 0, 0, 0x100, 0), _MATRIX, bytes(8), flags=7)
        top = full_box(b"mvhd", struct.pack(">IIIIIH10x", 0, 0, RATE, len(payload), 0x10000, 0x100), _MATRIX, bytes(24), struct.pack(">I", 2))
        return box(b"moov", top, box(b"trak", track, media))

    wide_data = len(payload) + 8 >= 1 << 32
    mark = struct.pack(">I4sQ", 1, b"mdat", len(payload) + 16) if wide_data else struct.pack(">I4s", len(payload) + 8, b"mdat")
    moov = movie(0)
    return head + movie(len(head) + len(moov) + len(mark)) + mark + payload


def walk(data: bytes, start: int = 0, end: int | None = None):
    """(path, first content byte, end) of every box in file order, those inside containers included."""
    pending = [((), start, len(data) if end is None else end)]
    while pending:
        path, at, stop = pending.pop()
        if stop - at < 8:
            if stop != at:
                raise ContainerFault(f"{stop - at} loose bytes at {at}")
            continue
        size, kind = struct.unpack_from(">I4s", data, at)
        header = 8
        if size == 1:
            if stop - at < 16:
                raise ContainerFault(f"cut size of {kind!r} at {at}")
            size, header = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif size == 0:
            size = stop - at
        if kind == b"uuid":
            header += 16
        if size < header or at + size > stop:
            raise ContainerFault(f"size {size} of {kind!r} at {at}")
        own = (*path, kind)
        yield own, at + header, at + size
        pending.append((path, at + size, stop))
        if kind in CONTAINERS:
            pending.append((own, at + header, at + size))


@dataclass
class Track:
    codec: str = ""
    timescale: int = 0
    duration: int = 0
    offsets: np.ndarray | None = None
    sizes: np.ndarray | None = None
    sync: np.ndarray | None = None  # sample indexes from 0

    def ranges(self) -> list[tuple[int, int]]:
        """Byte range of every keyframe."""
        return list(zip(self.offsets[self.sync].tolist(), self.sizes[self.sync].tolist()))

    def payload(self, data: bytes) -> bytes:
        """All samples in order; neighbours in the file are read at once."""
        if not len(self.offsets):
            return b""
        ends = self.offsets + self.sizes
        if (ends > len(data)).any():
            raise ContainerFault("a sample beyond the file")
        cuts = np.flatnonzero(self.offsets[1:] != ends[:-1]) + 1
        firsts, lasts = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(ends)]]) - 1
        return b"".join(data[a:b] for a, b in zip(self.offsets[firsts].tolist(), ends[lasts].tolist()))


def _numbers(data: bytes, at: int, end: int, kind: str, count: int) -> np.ndarray:
    if count * np.dtype(kind).itemsize > end - at:
        raise ContainerFault(f"a table of {count} entries in {end - at} bytes")
    return np.frombuffer(data, kind, count, at).astype(np.int64)


def _fitting(samples: int, size: int, data: bytes) -> int:
    if samples * max(size, 1) > len(data):
        raise ContainerFault(f"{samples} samples of {size} bytes in a file of {len(data)}")
    return samples


def _track(data: bytes, tables: dict[bytes, tuple[int, int]]) -> Track:
    def table(name, kind, width=1, skip=4):
        at, end = tables[name]
        count = int(_numbers(data, at + skip, end, ">u4", 1)[0])
        return _numbers(data, at + skip + 4, end, kind, count * width).reshape(-1, width)

    try:
        at, end = tables[b"mdhd"]
        long_times = data[at] == 1
        scale, duration = struct.unpack_from(">IQ" if long_times else ">II", data, at + (20 if long_times else 12))
        at, end = tables[b"stsd"]
        entries = int(_numbers(data, at + 4, end, ">u4", 1)[0])
        codec = data[at + 12 : at + 16].decode("latin-1") if entries else ""
        at, end = tables[b"stsz"]
        fixed, samples = struct.unpack_from(">II", data, at + 4)
        sizes = np.full(_fitting(samples, fixed, data), fixed, np.int64) if fixed else _numbers(data, at + 12, end, ">u4", samples)
        chunk_at = (table(b"co64", ">u8") if b"co64" in tables else table(b"stco", ">u4"))[:, 0]
        runs = table(b"stsc", ">u4", 3)
        timed = table(b"stts", ">u4", 2)
        sync = table(b"stss", ">u4")[:, 0] - 1 if b"stss" in tables else np.arange(samples)
    except (KeyError, struct.error, IndexError) as fault:
        raise ContainerFault(f"sample tables: {fault!r}") from fault
    if int(timed[:, 0].sum()) != samples or (len(sync) and (sync.min() < 0 or sync.max() >= samples)):
        raise ContainerFault("times or keyframes of other samples")
    if len(runs) and (runs[0, 0] != 1 or (np.diff(runs[:, 0]) <= 0).any() or runs[-1, 0] > max(len(chunk_at), 1)):
        raise ContainerFault("runs of chunks out of order")
    per_chunk = np.zeros(len(chunk_at), np.int64)
    for first, count, _ in runs.tolist():
        per_chunk[first - 1 :] = count
    if int(per_chunk.sum()) != samples:
        raise ContainerFault("chunks of other samples")
    before = np.concatenate([[0], np.cumsum(sizes)])
    first_sample = np.concatenate([[0], np.cumsum(per_chunk)])[:-1]
    offsets = np.repeat(chunk_at - before[first_sample], per_chunk) + before[:-1]
    return Track(codec, int(scale), int(duration), offsets, sizes, sync)


_NOT_SYNC = 0x10000


class _Reader:
    """Fields of a full box one after the other."""

    def __init__(self, data: bytes, at: int, end: int):
        self.data, self.at, self.end = data, at, end
        self.flags = self.take() & 0xFFFFFF

    def take(self, kind: str = ">I") -> int:
        if self.at + struct.calcsize(kind) > self.end:
            raise ContainerFault(f"cut fields at {self.at}")
        (value,) = struct.unpack_from(kind, self.data, self.at)
        self.at += struct.calcsize(kind)
        return value

    def maybe(self, flag: int, other: int = 0, kind: str = ">I") -> int:
        return self.take(kind) if self.flags & flag else other


def _run(data: bytes, fields: _Reader, base: int, next_at: int, duration: int, size: int, flags: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Offsets, sizes and sync flags of the samples of one fragment run, and its duration; the defaults are the fragment's."""
    count = fields.take()
    at = base + fields.take(">i") if fields.flags & 0x1 else next_at
    first_flags = fields.maybe(0x4, -1)
    columns = [bit for bit in (0x100, 0x200, 0x400, 0x800) if fields.flags & bit]
    if not columns:
        _fitting(count, size, data)
    table = _numbers(data, fields.at, fields.end, ">u4", count * len(columns)).reshape(count, len(columns))
    of = dict(zip(columns, table.T))
    sizes = of.get(0x200, np.full(count, size, np.int64))
    marks = of.get(0x400, np.full(count, flags, np.int64)).copy()
    if count and first_flags >= 0:
        marks[0] = first_flags
    lasts = int(of[0x100].sum()) if 0x100 in of else count * duration
    return at + np.cumsum(sizes) - sizes, sizes, (marks & _NOT_SYNC) == 0, lasts


def _add_fragments(data: bytes, fragments: list[tuple[int, list[tuple[bytes, int, int]]]], defaults: dict[int, tuple[int, int, int]], by_id: dict[int, Track]) -> None:
    """The samples of every movie fragment (its first byte and its header and run boxes) behind those of its track."""
    parts: dict[int, list] = {}
    for start, boxes in fragments:
        track, base, next_at, own = 0, start, start, (0, 0, 0)
        for kind, at, end in boxes:
            fields = _Reader(data, at, end)
            if kind == b"tfhd":
                track = fields.take()
                if track not in by_id:
                    raise ContainerFault(f"a fragment of no track, {track}")
                base = fields.maybe(0x1, start if fields.flags & 0x20000 else next_at, ">Q")
                fields.maybe(0x2)
                usual = defaults.get(track, (0, 0, 0))
                own = tuple(fields.maybe(bit, other) for bit, other in zip((0x8, 0x10, 0x20), usual))
                next_at = base
            elif track:
                found = _run(data, fields, base, next_at, *own)
                next_at = int(found[0][-1] + found[1][-1]) if len(found[0]) else next_at
                parts.setdefault(track, []).append(found)
    for number, found in parts.items():
        track = by_id[number]
        before = len(track.sizes)
        track.sync = np.concatenate([track.sync, before + np.flatnonzero(np.concatenate([f[2] for f in found]))])
        track.offsets = np.concatenate([track.offsets, *(f[0] for f in found)])
        track.sizes = np.concatenate([track.sizes, *(f[1] for f in found)])
        track.duration += sum(f[3] for f in found)


def parse(data: bytes) -> list[Track]:
    """Every track with all its samples, in the movie's tables and in fragments."""
    found: list[dict[bytes, tuple[int, int]]] = []
    fragments: list[tuple[int, list[tuple[bytes, int, int]]]] = []
    defaults: dict[int, tuple[int, int, int]] = {}
    for path, at, end in walk(data):
        if path == (b"moov", b"trak"):
            found.append({})
        elif len(path) > 2 and path[:2] == (b"moov", b"trak"):
            found[-1].setdefault(path[-1], (at, end))
        elif path == (b"moov", b"mvex", b"trex"):
            fields = _Reader(data, at, end)
            number, _, *own = (fields.take() for _ in range(5))
            defaults[number] = tuple(own)
        elif path == (b"moof",):
            fragments.append((at - (8 if data[at - 4 : at] == b"moof" else 16), []))
        elif path in ((b"moof", b"traf", b"tfhd"), (b"moof", b"traf", b"trun")):
            fragments[-1][1].append((path[-1], at, end))
    if not found:
        raise ContainerFault("no track")
    tracks = [_track(data, tables) for tables in found]
    if fragments:
        by_id = {}
        for tables, track in zip(found, tracks):
            if b"tkhd" not in tables:
                raise ContainerFault("a track without a header")
            at, end = tables[b"tkhd"]
            fields = _Reader(data, at, end)
            fields.at += 16 if data[at] == 1 else 8
            by_id[fields.take()] = track
        _add_fragments(data, fragments, defaults, by_id)
    return tracks


def feature(track: Track) -> str:
    keys = track.ranges()
    table = b"".join(struct.pack("<QQ", *k) for k in keys)
    first, last = (f"{a}+{n}" for a, n in (keys[0], keys[-1])) if keys else ("", "")
    return f"codec={track.codec.strip()};rate={track.timescale};duration={track.duration};samples={len(track.sizes)};keyframes={len(keys)};first={first};last={last};ranges={zlib.crc32(table):08x}"


def _stored(batches):
    for batch in small(batches):
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            raw = [(t or "").encode() for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([len(r) for r in raw], pa.int64()), pa.array([store(padded(r)) for r in raw], pa.binary())],
                ["doc_id", "n_bytes", "media"],
            )


def _read_back(batches):
    for batch in small(batches):
        columns: list[list] = [[] for _ in range(6)]
        for data in batch.column("media").to_pylist():
            track = parse(data)[0]
            payload = track.payload(data)
            for held, value in zip(
                columns,
                (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), feature(track)),
            ):
                held.append(value)
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, k) for c, k in zip(columns, kinds))],
            ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
        )


def store_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): every row's whole text, padded, in a container."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_stored, f"doc_id {id_type}, n_bytes long, media binary")


def text_round_trip(docs: DataFrame) -> DataFrame:
    """Every text stored, read back from the stored bytes, and its features."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    kinds = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return store_texts(docs).mapInArrow(_read_back, f"doc_id {id_type}, n_bytes long, {kinds}")


def _features(batches):
    key = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())]))
    kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), key, pa.string())
    for batch in small(batches):
        whose, rows = [], []
        for i, data in enumerate(batch.column("media").to_pylist()):
            try:
                own = [
                    (n, t.codec, t.timescale, t.duration, len(t.sizes), [{"offset": a, "length": k} for a, k in t.ranges()], None)
                    for n, t in enumerate(parse(data or b""))
                ]
            except ContainerFault as fault:
                own = [(None,) * 6 + (str(fault),)]
            rows += own
            whose += [i] * len(own)
        yield pa.RecordBatch.from_arrays(
            [batch.column("media_id").take(pa.array(whose, pa.int64())), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))],
            ["media_id", "track", "codec", "timescale", "duration", "samples", "keyframes", "fault"],
        )


def read_media(files: DataFrame) -> DataFrame:
    """(media_id, track, codec, timescale, duration, samples, keyframes, fault): one row for every track of every row (media_id, media) of ``files``."""
    id_type = files.schema["media_id"].dataType.simpleString()
    kinds = "track int, codec string, timescale long, duration long, samples long, keyframes array<struct<offset: long, length: long>>, fault string"
    return files.select("media_id", "media").mapInArrow(_features, f"media_id {id_type}, {kinds}")
