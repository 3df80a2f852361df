"""Media columns: ISO media containers (MP4, MOV, fragmented MP4).

`probe` walks the nested boxes of a container, decodes the sample tables, and
gives codec, duration and the byte ranges of keyframes for each track. It reads
boxes and tables only; payloads are neither decoded nor copied.

`mux_grey` is a small writer for lossless 8-bit samples: a payload of n * 576
bytes becomes n uncompressed grey frames of 24 x 24 pixels. Every frame is a
sync sample. Nothing in the container depends on time or machine, so equal
payloads give equal files.

Nulls and odd rows: a null container has no tracks and error `null`; one that is
cut off or malformed keeps the tracks that could be read and an error. Boxes of
size 0 reach to the end, 64-bit sizes are read, unknown boxes are skipped, and
boxes may be nested to any depth. Repeated rows give equal results. Other columns are kept by
`probe_column` and not read by the query.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.batches import map_rows
from docloom.llm.common import table

SIDE = 24
FRAME = SIDE * SIDE
TIMESCALE = 25

# Boxes that hold boxes, and what stands before the first.
CONTAINERS = {b"moov": 0, b"trak": 0, b"mdia": 0, b"minf": 0, b"stbl": 0, b"dinf": 0, b"edts": 0, b"udta": 0, b"mvex": 0, b"moof": 0, b"traf": 0, b"mfra": 0}
OF_TRACKS = frozenset([b"tkhd", b"mdhd", b"stsd", b"stts", b"stsc", b"stss", b"stsz", b"stco", b"co64", b"trun"])
LARGEST = 2**63 - 1


class Malformed(ValueError):
    pass


def boxes(data: memoryview, begin: int, end: int) -> Iterator[tuple[bytes, int, int, int]]:
    """(type, first byte, end) of the content of each box in a range, and the
    first byte of its header."""
    at = begin
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            if at + 16 > end:
                raise Malformed("box header is cut off")
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            raise Malformed(f"box {kind!r} of {size} bytes does not fit")
        yield kind, at + head, at + size, at
        at += size
    if at != end:
        raise Malformed("bytes after the last box")


@dataclass
class Track:
    track_id: int = 0
    handler: str = ""
    codec: str = ""
    timescale: int = 0
    duration: int = 0
    width: int = 0
    height: int = 0
    tables: dict[str, np.ndarray] = field(default_factory=dict)
    chunk_size: int = 32
    #: Of fragments: (sizes, offsets, sync, durations).
    runs: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def samples(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(offset, size, is keyframe) of every sample, in decoding order."""
        sizes = self.tables.get("stsz", np.zeros(0, np.int64))
        chunks = self.tables.get("stco", np.zeros(0, np.int64))
        runs = self.tables.get("stsc", np.zeros((0, 3), np.int64))
        offsets = np.zeros(len(sizes), np.int64)
        if len(sizes):
            if not len(chunks) or not len(runs):
                raise Malformed("samples without chunks")
            # Chunks from the first of a run on to that of the next have equal numbers of samples.
            # Numbers in a table may be anything: chunks are bounded by those there are, and samples by their sizes.
            until = np.minimum(np.append(runs[1:, 0], len(chunks) + 1), len(chunks) + 1)
            per_chunk = np.repeat(runs[:, 1], np.maximum(until - runs[:, 0], 0))[: len(chunks)]
            upto = np.minimum(np.cumsum(np.minimum(per_chunk, len(sizes))), len(sizes))
            if not len(upto) or upto[-1] < len(sizes):
                raise Malformed("fewer places than samples")
            chunk = np.repeat(np.arange(len(upto)), np.diff(upto, prepend=0))
            first = np.concatenate([[True], chunk[1:] != chunk[:-1]])
            before = np.cumsum(sizes) - sizes
            offsets = chunks[chunk] + before - before[np.flatnonzero(first)][np.cumsum(first) - 1]
        sync = np.ones(len(sizes), bool)
        if "stss" in self.tables:
            sync[:] = False
            marked = self.tables["stss"] - 1
            sync[marked[(marked >= 0) & (marked < len(sync))]] = True
        parts = [(offsets, sizes, sync), *((o, s, k) for s, o, k, _ in self.runs)]
        return tuple(np.concatenate([p[i] for p in parts]) for i in range(3))


def _table(data: memoryview, at: int, end: int, columns: int, kind: str = ">u4", skip: int = 4) -> np.ndarray:
    if at + skip + 4 > end:
        raise Malformed("table is cut off")
    n = struct.unpack_from(">I", data, at + skip)[0]
    width = np.dtype(kind).itemsize * columns
    if at + skip + 4 + n * width > end:
        raise Malformed("table is longer than its box")
    values = np.frombuffer(data, dtype=kind, count=n * columns, offset=at + skip + 4).astype(np.int64)
    return values.reshape(n, columns) if columns > 1 else values


class Parser:
    def __init__(self, data: bytes):
        self.data = memoryview(data)
        self.tracks: list[Track] = []
        self.defaults: dict[int, tuple[int, int, int]] = {}
        self.moof = 0
        self.brand = ""
        self.now: Track | None = None
        self.base: tuple[int, int, int, int] = (0, 0, 0, 0)
        self.run_end = 0

    def parse(self) -> None:
        """Boxes in file order, those of a container before what follows it. Open
        containers are a stack of ours, so nesting may be of any depth."""
        opened = [boxes(self.data, 0, len(self.data))]
        while opened:
            box = next(opened[-1], None)
            if box is None:
                opened.pop()
            elif self.enter(*box):
                opened.append(boxes(self.data, box[1], box[2]))

    def enter(self, kind: bytes, at: int, stop: int, header: int) -> bool:
        """Reads a box; whether it holds boxes."""
        if kind == b"trak":
            self.now = Track()
            self.tracks.append(self.now)
        elif kind == b"moof":
            self.moof = self.run_end = header
        if kind in CONTAINERS:
            return True
        if (read := getattr(self, "read_" + kind.decode("latin-1"), None)) is not None:
            if self.now is None and kind in OF_TRACKS:
                raise Malformed(f"box {kind!r} outside of a track")
            try:
                read(at, stop)
            except (struct.error, ValueError, IndexError, OverflowError) as e:
                raise e if isinstance(e, Malformed) else Malformed(f"box {kind!r}: {e}") from e
        return False

    def of(self, form: str, at: int) -> tuple:
        return struct.unpack_from(">" + form, self.data, at)

    def read_ftyp(self, at: int, end: int) -> None:
        self.brand = bytes(self.data[at : at + 4]).decode("latin-1")

    def read_tkhd(self, at: int, end: int) -> None:
        long = self.data[at] == 1
        self.now.track_id = self.of("I", at + (20 if long else 12))[0]
        self.now.width, self.now.height = (x >> 16 for x in self.of("II", at + (88 if long else 76)))

    def read_mdhd(self, at: int, end: int) -> None:
        self.now.timescale, self.now.duration = self.of("IQ", at + 20) if self.data[at] == 1 else self.of("II", at + 12)

    def read_hdlr(self, at: int, end: int) -> None:
        if self.now is not None and not self.now.handler:
            self.now.handler = bytes(self.data[at + 8 : at + 12]).decode("latin-1")

    def read_stsd(self, at: int, end: int) -> None:
        if self.of("I", at + 4)[0]:
            self.now.codec = bytes(self.data[at + 12 : at + 16]).decode("latin-1")
            if self.now.handler == "vide" and at + 44 <= end:
                self.now.width, self.now.height = self.of("HH", at + 40)

    def read_stts(self, at: int, end: int) -> None:
        self.now.tables["stts"] = _table(self.data, at, end, 2)

    def read_stsc(self, at: int, end: int) -> None:
        self.now.tables["stsc"] = _table(self.data, at, end, 3)

    def read_stss(self, at: int, end: int) -> None:
        self.now.tables["stss"] = _table(self.data, at, end, 1)

    def read_stsz(self, at: int, end: int) -> None:
        same, n = self.of("II", at + 4)
        if same:
            # A count is not proof of bytes: it is bounded by the file.
            if n * same > len(self.data):
                raise Malformed("more samples than bytes")
            self.now.tables["stsz"] = np.full(n, same, np.int64)
        else:
            self.now.tables["stsz"] = _table(self.data, at, end, 1, skip=8)

    def read_stco(self, at: int, end: int) -> None:
        self.now.tables["stco"] = _table(self.data, at, end, 1)

    def read_co64(self, at: int, end: int) -> None:
        self.now.tables["stco"] = _table(self.data, at, end, 1, ">u8")

    def read_trex(self, at: int, end: int) -> None:
        track, _, duration, size, flags = self.of("IIIII", at + 4)
        self.defaults[track] = (duration, size, flags)

    def read_tfhd(self, at: int, end: int) -> None:
        flags, track = self.of("I", at)[0] & 0xFFFFFF, self.of("I", at + 4)[0]
        self.now = next((t for t in self.tracks if t.track_id == track), None) or Track(track)
        if self.now not in self.tracks:
            self.tracks.append(self.now)
        at += 8
        base = self.moof
        if flags & 1:
            base, at = self.of("Q", at)[0], at + 8
        at += 4 if flags & 2 else 0
        values = list(self.defaults.get(track, (0, 0, 0)))
        for k, bit in enumerate((8, 16, 32)):
            if flags & bit:
                values[k], at = self.of("I", at)[0], at + 4
        self.base = (base, *values)
        self.run_end = base

    def read_trun(self, at: int, end: int) -> None:
        base, duration, size, default = self.base
        flags, n = self.of("I", at)[0] & 0xFFFFFF, self.of("I", at + 4)[0]
        at += 8
        begin = self.run_end
        if flags & 1:
            begin, at = base + self.of("i", at)[0], at + 4
        first = None
        if flags & 4:
            first, at = self.of("I", at)[0], at + 4
        columns = [bit for bit in (0x100, 0x200, 0x400, 0x800) if flags & bit]
        if n > len(self.data) or at + 4 * n * len(columns) > end:
            raise Malformed("run is longer than its box")
        values = np.frombuffer(self.data, ">u4", n * len(columns), at).astype(np.int64).reshape(n, len(columns))
        column = lambda bit, other: values[:, columns.index(bit)] if bit in columns else np.full(n, other, np.int64)
        sizes, marks = column(0x200, size), column(0x400, default)
        if first is not None and n:
            marks = np.concatenate([[first], marks[1:]])
        offsets = begin + np.cumsum(sizes) - sizes
        self.run_end = begin + int(sizes.sum())
        self.now.runs.append((sizes, offsets, (marks & 0x10000) == 0, column(0x100, duration)))


def _total(times: np.ndarray) -> int:
    """The sum of count times duration, beyond 64 bits too: by halves of 16
    bits, whose products are exact."""
    low, high = times[:, 0] & 0xFFFF, times[:, 0] >> 16
    return int((low * times[:, 1]).sum()) + (int((high * times[:, 1]).sum()) << 16)


def probe(data: bytes | None) -> dict:
    """brand, error and tracks: for each its id, handler, codec, size, timescale,
    duration, number of samples, and keyframes as (offset, size)."""
    if data is None:
        return {"brand": "", "error": "null", "tracks": []}
    parser, error = Parser(data), None
    try:
        parser.parse()
    except Malformed as e:
        error = str(e)
    tracks = []
    for t in parser.tracks:
        try:
            offsets, sizes, sync = t.samples()
        except Malformed as e:
            error, offsets, sizes, sync = error or str(e), np.zeros(0, int), np.zeros(0, int), np.zeros(0, bool)
        inside = (offsets >= 0) & (sizes >= 0) & (offsets <= len(data) - sizes)
        if not inside.all():
            error = error or "samples lie outside the file"
        sync &= inside
        duration = min(t.duration or _total(t.tables.get("stts", np.zeros((0, 2), int))) + int(sum(r[3].sum() for r in t.runs)), LARGEST)
        tracks.append({
            "track_id": t.track_id, "handler": t.handler, "codec": t.codec, "width": t.width, "height": t.height, "timescale": t.timescale, "duration": duration,
            "n_samples": len(sizes), "keyframes": [{"offset": int(o), "size": int(s)} for o, s in zip(offsets[sync], sizes[sync], strict=True)],
        })
    return {"brand": parser.brand, "error": error, "tracks": tracks}


PROBED = pa.struct([
    ("brand", pa.string()), ("error", pa.string()),
    ("tracks", pa.list_(pa.struct([
        ("track_id", pa.int64()), ("handler", pa.string()), ("codec", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("timescale", pa.int64()),
        ("duration", pa.int64()), ("n_samples", pa.int64()), ("keyframes", pa.list_(pa.struct([("offset", pa.int64()), ("size", pa.int64())]))),
    ]))),
])
PROBED_SQL = "struct<brand:string,error:string,tracks:array<struct<track_id:bigint,handler:string,codec:string,width:int,height:int,timescale:bigint,duration:bigint,n_samples:bigint,keyframes:array<struct<offset:bigint,size:bigint>>>>>"


def probe_column(df: DataFrame, media_col: str = "media", out_col: str = "probed", rows: int = 64) -> DataFrame:
    """df with out_col, what `probe` finds in media_col, instead of media_col."""
    others = [c for c in df.columns if c != media_col]
    chosen = df.select(*[F.col(f"`{c}`") for c in others], F.col(media_col).cast("binary").alias("_media"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [probe(x) for x in batch.column(len(others)).to_pylist()]
        return pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(others))), pa.array(found, PROBED)], [*others, out_col])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in chosen.schema.fields[:-1])
    return map_rows(chosen, run, f"{kinds}`{out_col}` {PROBED_SQL}", rows)


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
FTYP = box(b"ftyp", b"qt  ", struct.pack(">I", 0), b"qt  ")


def mux_grey(payload: bytes) -> bytes:
    """A container of len(payload) / 576 grey frames. The payload comes right
    after the file type, so that its place does not depend on its length."""
    n, rest = divmod(len(payload), FRAME)
    if rest or not n:
        raise ValueError("the payload must be a positive multiple of 576 bytes")
    long = len(payload) + 16 > 0xFFFFFFFF
    head = struct.pack(">I4sQ", 1, b"mdat", len(payload) + 16) if long else struct.pack(">I4s", len(payload) + 8, b"mdat")
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", SIDE, SIDE, 0x480000, 0x480000, 0, 1), bytes(32), struct.pack(">Hh", 40, -1))
    stbl = box(
        b"stbl", full(b"stsd", struct.pack(">I", 1), entry), full(b"stts", struct.pack(">III", 1, n, 1)), full(b"stss", struct.pack(">I", n), np.arange(1, n + 1, dtype=">u4").tobytes()),
        full(b"stsc", struct.pack(">IIII", 1, 1, n, 1)), full(b"stsz", struct.pack(">II", FRAME, n)), full(b"stco", struct.pack(">II", 1, len(FTYP) + len(head))),
    )
    minf = box(b"minf", full(b"vmhd", bytes(8), flags=1), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), stbl)
    mdia = box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, TIMESCALE, n, 0x55C4, 0)), full(b"hdlr", bytes(4), b"vide", bytes(12), b"\0"), minf)
    tkhd = full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, n), bytes(8), struct.pack(">HHHH", 0, 0, 0, 0), MATRIX, struct.pack(">II", SIDE << 16, SIDE << 16), flags=3)
    mvhd = full(b"mvhd", struct.pack(">IIIIIH", 0, 0, TIMESCALE, n, 0x10000, 0x100), bytes(10), MATRIX, bytes(24), struct.pack(">I", 2))
    return b"".join([FTYP, head, payload, box(b"moov", mvhd, box(b"trak", tkhd, mdia))])


def pad(data: bytes) -> bytes:
    """data with bytes 255 up to a positive multiple of 576."""
    return data + b"\xff" * (-len(data) % FRAME if data else FRAME)


def read_track(data: bytes, probed: dict) -> bytes:
    """The payload of a track of keyframes only, as stored."""
    ranges = probed["tracks"][0]["keyframes"]
    return b"".join(data[k["offset"] : k["offset"] + k["size"]] for k in ranges)


def feature(probed: dict, payload: bytes) -> str:
    """Codec, frame size, duration, keyframes with first and last byte, and the
    mean brightness of the frames in thousandths."""
    t = probed["tracks"][0]
    keys = t["keyframes"]
    mean = int(np.frombuffer(payload, np.uint8).sum(dtype=np.int64)) * 1000 // len(payload)
    return f"{probed['brand'].strip()}/{t['codec'].strip()} {t['width']}x{t['height']} duration={t['duration']}/{t['timescale']} keyframes={len(keys)} bytes={keys[0]['offset']}-{keys[-1]['offset'] + keys[-1]['size']} mean={mean}"


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores every text as a container, probes the container, and reads the
    payload back through the byte ranges found there."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("data"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: dict[str, list] = {k: [] for k in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
        for data in batch.column(1).to_pylist():
            media = mux_grey(pad(data))
            probed = probe(media)
            payload = read_track(media, probed)
            row = (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(probed, payload))
            for column, x in zip(out.values(), row, strict=True):
                column.append(x)
        arrays = [pa.array(v, pa.string() if "sha" in k or k == "feature" else pa.int64()) for k, v in out.items()]
        return pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", *out])

    return map_rows(docs, run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", 256)
