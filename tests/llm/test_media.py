from __future__ import annotations

import hashlib
import random
import struct
import tracemalloc
import zlib

import pyarrow as pa
import pytest

from docloom.llm import media as M
from tests.llm import odd


@pytest.mark.parametrize("data", [b"", b"x", b"a" * 576, b"a" * 577, bytes(range(256)) * 50, "é".encode() * 40_000])
def test_round_trip(data):
    payload = M.pad(data)
    assert payload.startswith(data) and len(payload) % 576 == 0 and len(payload) >= 576 and set(payload[len(data):]) <= {255}
    stored = M.mux_grey(payload)
    found = M.probe(stored)
    assert found["error"] is None and M.read_track(stored, found) == payload
    track = found["tracks"][0]
    assert (track["codec"], track["width"], track["height"], track["duration"], track["n_samples"]) == ("raw ", 24, 24, len(payload) // 576, len(payload) // 576)
    assert stored == M.mux_grey(payload)


def test_cut_anywhere_gives_an_error_and_never_fails():
    stored = M.mux_grey(M.pad(b"text"))
    for n in range(len(stored)):
        found = M.probe(stored[:n])
        # a cut between top boxes leaves a shorter valid file, without tracks
        assert found["error"] is not None or not found["tracks"]
    assert M.probe(None)["error"] == "null" and M.probe(b"")["tracks"] == []


def test_other_layouts():
    """64-bit sizes and offsets, some keyframes only, several chunks, equal sizes."""
    payload = b"k" * 10 + b"p" * 5 + b"p" * 5 + b"K" * 12
    ftyp = M.box(b"ftyp", b"isom", bytes(4))
    head = struct.pack(">I4sQ", 1, b"mdat", len(payload) + 16)
    at = len(ftyp) + 16
    stbl = M.box(
        b"stbl", M.full(b"stsd", struct.pack(">I", 1), M.box(b"avc1", bytes(78))), M.full(b"stts", struct.pack(">III", 1, 4, 40)), M.full(b"stss", struct.pack(">III", 2, 1, 4)),
        M.full(b"stsc", struct.pack(">IIIIIII", 2, 1, 3, 1, 2, 1, 1)), M.full(b"stsz", struct.pack(">II4I", 0, 4, 10, 5, 5, 12)), M.full(b"co64", struct.pack(">IQQ", 2, at, at + 20)),
    )
    mdia = M.box(b"mdia", M.full(b"mdhd", struct.pack(">QQIQHH", 0, 0, 1000, 160, 0, 0), version=1), M.full(b"hdlr", bytes(4), b"vide", bytes(13)), M.box(b"minf", stbl))
    found = M.probe(ftyp + head + payload + M.box(b"moov", M.box(b"trak", mdia)) + M.box(b"free", b"zz"))
    track = found["tracks"][0]
    assert found["error"] is None and (track["codec"], track["timescale"], track["duration"], track["n_samples"]) == ("avc1", 1000, 160, 4)
    assert track["keyframes"] == [{"offset": at, "size": 10}, {"offset": at + 20, "size": 12}]


def test_fragments():
    moov = M.box(b"moov", M.box(b"trak", M.full(b"tkhd", struct.pack(">IIIII", 0, 0, 7, 0, 0), bytes(60))), M.box(b"mvex", M.full(b"trex", struct.pack(">IIIII", 7, 1, 20, 100, 0x10000))))
    trun = M.full(b"trun", struct.pack(">IiI", 2, 64, 0), struct.pack(">II", 30, 40), flags=0x205)
    moof = M.box(b"moof", M.box(b"traf", M.full(b"tfhd", struct.pack(">I", 7), flags=0x20000), trun))
    data = moov + moof + M.box(b"mdat", bytes(80))
    track = M.probe(data)["tracks"][0]
    assert track["n_samples"] == 2 and track["duration"] == 40
    assert track["keyframes"] == [{"offset": len(moov) + 64, "size": 30}]


def test_query_columns(spark, tmp_path):
    odd.documents(spark).write.parquet(f"{tmp_path}/documents.parquet")
    rows = M.op1_media_columns(spark, str(tmp_path)).collect()
    texts = {(r.doc_id, r.n_chars): r.text or "" for r in odd.documents(spark).collect()}
    assert len(rows) == 10
    for r in rows:
        data = next(t for (i, _), t in texts.items() if i == r.doc_id).encode()
        payload = M.pad(data)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))


def test_probe_column(spark):
    df = spark.createDataFrame([(1, M.mux_grey(M.pad(b"a")), "x"), (2, None, "y"), (3, b"junk", None)], "id long, media binary, probed_by string")
    rows = {r.id: r for r in M.probe_column(df).collect()}
    assert rows[1].probed.tracks[0].keyframes[0].size == 576 and rows[2].probed.error == "null" and rows[3].probed.error and rows[3].probed_by is None
    assert M.probe_column(df.limit(0)).count() == 0


NUMBERS = [0, 1, 2, 255, 2**16 - 1, 2**31 - 1, 2**31, 2**32 - 1]
KINDS = [b"ftyp", b"moov", b"trak", b"mdia", b"minf", b"stbl", b"tkhd", b"mdhd", b"hdlr", b"stsd", b"stts", b"stsc", b"stss", b"stsz", b"stco", b"co64", b"mvex", b"trex", b"moof", b"traf", b"tfhd", b"trun", b"mdat", b"free"]


def test_boxes_outside_of_tracks_and_of_no_length():
    for kind in KINDS:
        for body in (b"", b"\1", bytes(4), bytes(40), b"\xff" * 60):
            for outer in (lambda x: x, lambda x: M.box(b"moov", M.box(b"trak", x)), lambda x: M.box(b"moof", M.box(b"traf", x))):
                found = M.probe(outer(M.box(kind, body)))
                pa.array([found], M.PROBED)


def test_numbers_of_tables_do_not_allocate():
    top = 2**32 - 1
    for stsc in ((1, top, 1), (top, 1, 1), (1, 1, 1)):
        stbl = M.box(b"stbl", M.full(b"stsc", struct.pack(">I3I", 1, *stsc)), M.full(b"stsz", struct.pack(">II2I", 0, 2, 5, 5)), M.full(b"stco", struct.pack(">II", 1, 0)), M.full(b"stts", struct.pack(">III", 1, top, top)))
        tracemalloc.start()
        found = M.probe(M.box(b"moov", M.box(b"trak", M.box(b"mdia", M.box(b"minf", stbl)))))
        assert tracemalloc.get_traced_memory()[1] < 1_000_000
        tracemalloc.stop()
        assert found["tracks"][0]["duration"] == min(top * top, 2**63 - 1)
        pa.array([found], M.PROBED)


@pytest.mark.parametrize("seed", range(4))
def test_random_changes_never_fail(seed):
    r = random.Random(seed)
    moov = M.box(b"moov", M.box(b"trak", M.full(b"tkhd", struct.pack(">IIIII", 0, 0, 7, 0, 0), bytes(60))), M.box(b"mvex", M.full(b"trex", struct.pack(">IIIII", 7, 1, 20, 100, 0x10000))))
    trun = M.full(b"trun", struct.pack(">IiI", 2, 64, 0), struct.pack(">II", 30, 40), flags=0x205)
    fragments = moov + M.box(b"moof", M.box(b"traf", M.full(b"tfhd", struct.pack(">I", 7), flags=0x20000), trun)) + M.box(b"mdat", bytes(80))
    for _ in range(1500):
        data = bytearray(r.choice([M.mux_grey(M.pad(b"a" * r.randrange(1500))), fragments]))
        for _ in range(r.randint(1, 6)):
            at = r.randrange(len(data) - 8)
            if r.random() < 0.3:
                data[at : at + 4] = r.choice(KINDS)
            elif r.random() < 0.5:
                data[at : at + 4] = struct.pack(">I", r.choice(NUMBERS))
            else:
                data[at] = r.randrange(256)
        pa.array([M.probe(bytes(data))], M.PROBED)


def test_long_header_of_a_fragment():
    """Offsets count from the first byte of the fragment's box."""
    def long(kind, body):
        return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body

    moov = M.box(b"moov", M.box(b"trak", M.full(b"tkhd", struct.pack(">IIIII", 0, 0, 7, 0, 0), bytes(60))))
    trun = M.full(b"trun", struct.pack(">IiI", 1, 64, 0), struct.pack(">I", 30), flags=0x205)
    moof = long(b"moof", M.box(b"traf", M.full(b"tfhd", struct.pack(">I", 7), flags=0x20000), trun))
    assert M.probe(moov + moof + M.box(b"mdat", bytes(80)))["tracks"][0]["keyframes"] == [{"offset": len(moov) + 64, "size": 30}]


def test_any_depth():
    deep = b""
    for _ in range(3000):
        deep = M.box(b"udta", deep)
    stored = M.mux_grey(M.pad(b"text"))
    found = M.probe(deep + stored[: stored.index(b"mdat") - 4])
    assert found["error"] is None
    moved = M.probe(stored + M.box(b"moov", deep) + M.box(b"moov", M.box(b"trak", M.full(b"tkhd", struct.pack(">IIIII", 0, 0, 7, 0, 0), bytes(60)))))
    assert moved["error"] is None and len(moved["tracks"]) == 2 and M.read_track(stored, moved) == M.pad(b"text")
