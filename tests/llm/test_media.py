import hashlib
import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewright.llm.media import ContainerFault, box, feature, padded, parse, read_media, store, text_round_trip, walk


@given(st.binary(max_size=20_000))
@settings(max_examples=60, deadline=None)
def test_exact_round_trip(raw):
    payload = padded(raw)
    assert len(payload) % 64 == 0 and payload[: len(raw)] == raw and payload
    data = store(payload)
    (track,) = parse(data)
    assert track.payload(data) == payload
    assert all(data[a : a + n] in payload for a, n in track.ranges())
    assert (track.codec, track.timescale, track.duration) == ("raw ", 8000, len(payload))


def test_boxes_nest_and_cover_the_file():
    data = store(bytes(64))
    assert [p for p, _, _ in walk(data) if len(p) == 1] == [(b"ftyp",), (b"moov",), (b"mdat",)]
    assert (b"moov", b"trak", b"mdia", b"minf", b"stbl", b"stsz") in [p for p, _, _ in walk(data)]


def test_other_layouts_are_read():
    data = store(padded(bytes(range(256)) * 40))
    spare = box(b"free", b"abc")
    wide = data[: data.index(b"mdat") - 4]
    payload = data[data.index(b"mdat") + 4 :]
    # the data box with a 64-bit size, after a free box: chunk offsets move by both
    moved = wide + spare + struct.pack(">I4sQ", 1, b"mdat", 16 + len(payload)) + payload
    shift = len(spare) + 8
    at = moved.index(b"stco") + 8
    count = struct.unpack_from(">I", moved, at)[0]
    places = struct.unpack_from(f">{count}I", moved, at + 4)
    moved = moved[: at + 4] + struct.pack(f">{count}I", *(p + shift for p in places)) + moved[at + 4 + 4 * count :]
    assert parse(moved)[0].payload(moved) == payload
    assert "keyframes=3" in feature(parse(moved)[0])


@pytest.mark.parametrize("bad", [b"", b"abc", store(bytes(64))[:-1], b"\0\0\0\4ftyp", box(b"moov"), box(b"moov", box(b"trak")), b"\0\0\0\1mdat"])
def test_faults(bad):
    with pytest.raises(ContainerFault):
        parse(bad)


def test_rows(spark):
    rows = [(1, "héllo", 5), (1, "héllo", 5), (None, None, None), (2, "", 0), (3, "x" * 200_000, 1)]
    found = text_round_trip(spark.createDataFrame(rows, "doc_id long, text string, media int")).collect()
    assert [(r.doc_id, r.n_bytes, r.payload_bytes) for r in found] == [(1, 6, 64), (1, 6, 64), (None, 0, 64), (2, 0, 64), (3, 200_000, 200_000)]
    for r, text in zip(found, ["héllo", "héllo", "", "", "x" * 200_000]):
        payload = padded(text.encode())
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])
    assert found[0].media_sha256 == found[1].media_sha256 and found[2].feature == found[3].feature
    assert text_round_trip(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_media_columns_and_faults(spark):
    files = spark.createDataFrame([("a", store(bytes(64 * 65))), ("b", b"junk junk"), ("c", None)], "media_id string, media binary")
    a, b, c = read_media(files).orderBy("media_id").collect()
    assert (a.codec, a.duration, len(a.keyframes), a.fault) == ("raw ", 64 * 65, 2, None)
    assert b.codec is None and b.fault and c.fault


def _moov(data):
    (at, end) = next((a, b) for p, a, b in walk(data) if p == (b"moov",))
    return data[at:end]


def _with_tracks(payload, *more):
    """The stored file's movie box with more boxes, behind the data, whose place does not change."""
    data = store(payload)
    free = next(a - 8 for p, a, _ in walk(data) if p == (b"moov",))
    end = next(b for p, _, b in walk(data) if p == (b"moov",))
    return data[:free] + box(b"free", bytes(end - free - 8)) + data[end:] + box(b"moov", _moov(data), *more)


def test_every_track_is_returned(spark):
    payload = bytes(range(64)) * 70
    other = next(store(payload)[a - 8 : b] for p, a, b in walk(store(payload)) if p == (b"moov", b"trak"))
    files = spark.createDataFrame([(1, _with_tracks(payload, other))], "media_id long, media binary")
    rows = read_media(files).collect()
    assert [(r.media_id, r.track, r.samples, len(r.keyframes)) for r in rows] == [(1, 0, 70, 2), (1, 1, 70, 2)]


def fragment(at, sizes, flags_of, duration, base_is_moof=True):
    """A movie fragment and its data: one run with sizes and flags of each sample."""
    def boxes(place):
        head = box(b"tfhd", struct.pack(">III", 0x20008 if base_is_moof else 0x8, 1, duration))
        samples = b"".join(struct.pack(">II", n, f) for n, f in zip(sizes, flags_of))
        run = box(b"trun", struct.pack(">III", 0x601, len(sizes), place), samples)
        return box(b"moof", box(b"mfhd", bytes(8)), box(b"traf", head, run))

    moof = boxes(0)
    return boxes(len(moof) + 8) + box(b"mdat", bytes(sum(sizes)))


def test_fragments_are_read():
    movie = _with_tracks(bytes(64), box(b"mvex", box(b"trex", struct.pack(">6I", 0, 1, 1, 5, 7, 0x10000))))
    one = fragment(len(movie), [10, 20, 30], [0, 0x10000, 0], 100)
    two = fragment(len(movie) + len(one), [5, 6], [0x10000, 0], 9, base_is_moof=False)
    data = movie + one + two
    (track,) = parse(data)
    first = len(movie) + len(one) - 60
    last = len(data) - 11
    assert track.ranges() == [(track.offsets[0], 64), (first, 10), (first + 30, 30), (last + 5, 6)]
    assert track.sizes.tolist() == [64, 10, 20, 30, 5, 6] and track.duration == 64 + 300 + 18
    usual = movie + box(b"moof", box(b"traf", box(b"tfhd", struct.pack(">II", 0x20000, 1)), box(b"trun", struct.pack(">III", 0x4, 3, 0)))) + bytes(21)
    (track,) = parse(usual[:-21] + box(b"mdat", bytes(21)))
    assert track.sizes.tolist() == [64, 7, 7, 7] and track.sync.tolist() == [0, 1] and track.duration == 64 + 15
    with pytest.raises(ContainerFault):
        parse(movie + box(b"moof", box(b"traf", box(b"tfhd", struct.pack(">II", 0x20000, 9)))))
    with pytest.raises(ContainerFault):
        parse(movie + box(b"moof", box(b"traf", box(b"tfhd", struct.pack(">II", 0x20000, 1)), box(b"trun", struct.pack(">II", 0, 0xFFFFFFFF)))))


@pytest.mark.parametrize("name,shift,value", [(b"stsz", 12, 0xFFFFFFFF), (b"stsc", 12, 0), (b"stsc", 12, 9)])
def test_tables_that_state_what_the_file_cannot_hold(name, shift, value):
    data = bytearray(store(bytes(64)))
    at = data.index(name) + shift
    data[at : at + 4] = struct.pack(">I", value)
    if name == b"stsz":
        at = data.index(b"stts") + 12
        data[at : at + 4] = struct.pack(">I", value)
    with pytest.raises(ContainerFault):
        parse(bytes(data))
