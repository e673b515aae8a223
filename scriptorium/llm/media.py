"""ISO media containers as columns.

``parse`` walks nested boxes and decodes the sample tables of each track; it
reads no payload.  ``pack`` writes bytes losslessly as samples of an 8-bit
track, which the query reads back.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, slices

UNIT = 192
#: Boxes that hold other boxes.
CONTAINERS = frozenset([b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta", b"mvex", b"moof", b"traf"])
TIMESCALE = 48_000
#: Samples of a chunk, and distance of keyframes, in packed files.
CHUNK_SAMPLES, KEY_EVERY = 16, 8


@dataclass
class Track:
    """A track's tables as they are stored."""

    handler: str = ""
    codec: str = ""
    timescale: int = 0
    duration: int = 0
    times: list[tuple[int, int]] = field(default_factory=list)
    chunks: list[tuple[int, int]] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    offsets: list[int] = field(default_factory=list)
    keys: list[int] | None = None
    number: int = 0
    fragments: list[tuple[int, int, bool]] = field(default_factory=list)  #: (offset, size, whether it is a keyframe) of each fragment sample
    fragment_ticks: int = 0

    @property
    def ticks(self) -> int:
        """The duration of all samples; of fragmented files the header names only what lies outside fragments."""
        return self.duration + self.fragment_ticks

    def samples(self) -> list[tuple[int, int]]:
        """(offset, size) of each sample in decoding order, those of fragments last."""
        return self._table_samples() + [(at, size) for at, size, _ in self.fragments]

    def _table_samples(self) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        runs = self.chunks
        at = run = 0
        for i, offset in enumerate(self.offsets, 1):
            while run + 1 < len(runs) and runs[run + 1][0] <= i:
                run += 1
            for _ in range(runs[run][1] if runs else 0):
                if at == len(self.sizes):
                    return out
                out.append((offset, self.sizes[at]))
                offset += self.sizes[at]
                at += 1
        return out

    def keyframes(self) -> list[tuple[int, int]]:
        """(offset, size) of the sync samples; without a table of them every sample is one."""
        found = self._table_samples()
        own = found if self.keys is None else [found[k - 1] for k in self.keys if 0 < k <= len(found)]
        return own + [(at, size) for at, size, key in self.fragments if key]


def boxes(data: bytes, at: int = 0, end: int | None = None) -> Iterator[tuple[bytes, int, int]]:
    """(type, start, end of the content) of each box from ``at`` on; 64-bit and to-the-end sizes included."""
    end = len(data) if end is None else end
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            if at + 16 > end:
                raise ValueError("a large box is cut short")
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            raise ValueError(f"box {kind.decode('latin-1')} at {at} doesn't fit")
        yield kind, at + head, at + size
        at += size


def _table(data: bytes, at: int, end: int, kind: str, skip: int = 4) -> list[tuple[int, ...]]:
    """Entries after version, flags, ``skip - 4`` bytes and a count."""
    n = struct.unpack_from(">I", data, at + skip)[0]
    step = struct.calcsize(">" + kind)
    if at + skip + 4 + n * step > end:
        raise ValueError("a table is cut short")
    return list(struct.iter_unpack(">" + kind, data[at + skip + 4 : at + skip + 4 + n * step]))


def parse(data: bytes) -> list[Track]:
    """The tracks of a file, fragments included. Raises ValueError if a box or table doesn't fit.

    Edit lists and composition offsets move samples in presentation time only; they change neither ranges nor media duration.
    """
    tracks: list[Track] = []
    defaults: dict[int, tuple[int, int, int]] = {}  # of each track: duration, size and flags of a fragment's samples

    def look(at: int, end: int) -> None:
        for kind, a, b in boxes(data, at, end):
            if kind == b"trak":
                tracks.append(Track())
                _walk(data, a, b, tracks[-1])
            elif kind == b"trex":
                number, _, *own = struct.unpack_from(">IIIII", data, a + 4)
                defaults[number] = tuple(own)
            elif kind == b"moof":
                fragments.append((at_box(a), a, b))
            elif kind in CONTAINERS:
                look(a, b)

    def at_box(content: int) -> int:
        """Where the box with this content begins."""
        return content - (16 if data[content - 16 : content - 12] == b"\0\0\0\1" and data[content - 12 : content - 8] == b"moof" else 8)

    fragments: list[tuple[int, int, int]] = []
    try:
        look(0, len(data))
        for start, a, b in fragments:
            base = start
            for kind, c, d in boxes(data, a, b):
                if kind == b"traf":
                    base = _fragment(data, c, d, start, base, {t.number: t for t in tracks}, defaults)
    except (struct.error, RecursionError, IndexError, OverflowError) as e:
        raise ValueError(f"the file is damaged: {e}") from e
    return tracks


def _fragment(data: bytes, at: int, end: int, moof: int, after: int, tracks: dict[int, Track], defaults: dict[int, tuple[int, int, int]]) -> int:
    """Read the runs of a track's fragment; returns where the data after its last sample is."""
    track, ticks, size, flags, base = None, 0, 0, 0, after
    for kind, a, b in boxes(data, at, end):
        if kind == b"tfhd":
            mark, number = struct.unpack_from(">II", data, a)
            track, p = tracks.get(number), a + 8
            ticks, size, flags = defaults.get(number, (0, 0, 0))
            # a base of its own, or the fragment's box where the flag says so or no fragment came before
            base = moof if mark & 0x020000 else after
            if mark & 1:
                base, p = struct.unpack_from(">Q", data, p)[0], p + 8
            p += 4 * bool(mark & 2)
            for bit in (8, 16, 32):
                if mark & bit:
                    value, p = struct.unpack_from(">I", data, p)[0], p + 4
                    ticks, size, flags = (value if bit == 8 else ticks, value if bit == 16 else size, value if bit == 32 else flags)
            after = base
        elif kind == b"trun":
            mark, n = struct.unpack_from(">II", data, a)
            p = a + 8
            if mark & 1:
                after, p = base + struct.unpack_from(">i", data, p)[0], p + 4
            first = None
            if mark & 4:
                first, p = struct.unpack_from(">I", data, p)[0], p + 4
            fields = [bit for bit in (0x100, 0x200, 0x400, 0x800) if mark & bit]
            if p + 4 * n * len(fields) > b or n > len(data):
                raise ValueError("a run is cut short")
            for i in range(n):
                own = dict(zip(fields, struct.unpack_from(f">{len(fields)}I", data, p)))
                p += 4 * len(fields)
                length = own.get(0x200, size)
                mine = own.get(0x400, first if i == 0 and first is not None else flags)
                if track is not None:
                    track.fragments.append((after, length, not mine & 0x10000))
                    track.fragment_ticks += own.get(0x100, ticks)
                after += length
    return after


def _walk(data: bytes, at: int, end: int, track: Track) -> None:
    for kind, a, b in boxes(data, at, end):
        if kind in CONTAINERS:
            _walk(data, a, b, track)
        elif kind == b"mdhd":
            track.timescale, track.duration = struct.unpack_from(">IQ" if data[a] else ">II", data, a + (20 if data[a] else 12))
        elif kind == b"tkhd":
            track.number = struct.unpack_from(">I", data, a + (20 if data[a] else 12))[0]
        elif kind == b"stz2":
            bits, n = data[a + 7], struct.unpack_from(">I", data, a + 8)[0]
            if bits not in (4, 8, 16) or a + 12 + (n * bits + 7) // 8 > b:
                raise ValueError("a table is cut short")
            raw = data[a + 12 : b]
            track.sizes = [raw[i // 2] >> 4 * (1 - i % 2) & 15 for i in range(n)] if bits == 4 else list(raw[:n]) if bits == 8 else list(struct.unpack_from(f">{n}H", raw))
        elif kind == b"hdlr":
            track.handler = data[a + 8 : a + 12].decode("latin-1")
        elif kind == b"stsd":
            track.codec = data[a + 12 : a + 16].decode("latin-1") if struct.unpack_from(">I", data, a + 4)[0] else ""
        elif kind == b"stts":
            track.times = _table(data, a, b, "II")
        elif kind == b"stsc":
            track.chunks = [(first, n) for first, n, _ in _table(data, a, b, "III")]
        elif kind == b"stsz":
            same, n = struct.unpack_from(">II", data, a + 4)
            if same and n > len(data):
                raise ValueError("more samples than bytes")
            track.sizes = [same] * n if same else [x for x, in _table(data, a, b, "I", 8)]
        elif kind == b"stco":
            track.offsets = [x for x, in _table(data, a, b, "I")]
        elif kind == b"co64":
            track.offsets = [x for x, in _table(data, a, b, "Q")]
        elif kind == b"stss":
            track.keys = [x for x, in _table(data, a, b, "I")]


def _box(kind: bytes, *content: bytes) -> bytes:
    body = b"".join(content)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def _full(kind: bytes, *content: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *content)


_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def pack(payload: bytes, unit: int = UNIT) -> bytes:
    """A file with one track of raw 8-bit samples, ``unit`` bytes each; the length must be a positive multiple of it."""
    n, rest = divmod(len(payload), unit)
    if not n or rest:
        raise ValueError("the payload isn't a positive multiple of the unit")
    kinds = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2mp41")
    full, last = divmod(n, CHUNK_SAMPLES)
    runs = [(1, CHUNK_SAMPLES)] * bool(full) + [(full + 1, last)] * bool(last)
    keys = range(1, n + 1, KEY_EVERY)
    media = len(kinds) + 8
    offsets = [media + i * unit * CHUNK_SAMPLES for i in range(full + bool(last))]
    entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, TIMESCALE << 16))
    stbl = _box(
        b"stbl", _full(b"stsd", struct.pack(">I", 1), entry), _full(b"stts", struct.pack(">III", 1, n, unit)),
        _full(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)),
        _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", first, k, 1) for first, k in runs)),
        _full(b"stsz", struct.pack(">II", unit, n)), _full(b"stco", struct.pack(f">I{len(offsets)}I", len(offsets), *offsets)),
    )
    dinf = _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1)))
    minf = _box(b"minf", _full(b"smhd", bytes(4)), dinf, stbl)
    hdlr = _full(b"hdlr", bytes(4), b"soun", bytes(12), b"\0")
    mdia = _box(b"mdia", _full(b"mdhd", struct.pack(">QQIQHH", 0, 0, TIMESCALE, n * unit, 0x55C4, 0), version=1), hdlr, minf)
    tkhd = _full(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, n * unit), bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), _MATRIX, bytes(8), version=1, flags=7)
    mvhd = _full(b"mvhd", struct.pack(">QQIQ", 0, 0, TIMESCALE, n * unit), struct.pack(">IHH", 0x10000, 0x100, 0), bytes(8), _MATRIX, bytes(24), struct.pack(">I", 2), version=1)
    if media + len(payload) >= 1 << 32:
        raise ValueError("the payload is too long for 32-bit offsets")
    return kinds + _box(b"mdat", payload) + _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))


MEDIA = "array<struct<handler:string,codec:string,timescale:long,duration:long,samples:long,keyframes:array<struct<offset:long,size:long>>>>"


def media_columns(files: DataFrame, column: str = "content", out: str = "tracks") -> DataFrame:
    """Add ``out`` (handler, codec, timescale, duration, samples and keyframe byte ranges of each track) and ``<out>_error`` to a table of files.

    Null gives null in both; bytes that aren't a whole file give null and a
    message, whatever the damage; a file without tracks gives an empty array.
    Duration and ranges come from the tables and fragment runs; payloads aren't
    decoded.  A column named ``out`` is replaced; other columns and repeated
    rows stay as they are; an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 16):
            tracks, errors = [], []
            for data in part.column(0).to_pylist():
                try:
                    got = None if data is None else [
                        {"handler": t.handler, "codec": t.codec, "timescale": t.timescale, "duration": t.ticks, "samples": len(t.samples()),
                         "keyframes": [{"offset": o, "size": s} for o, s in t.keyframes()]} for t in parse(data)
                    ]
                    tracks.append(got)
                    errors.append(None)
                except (ValueError, struct.error) as e:
                    tracks.append(None)
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([pa.array(tracks, _ARROW), pa.array(errors, pa.string())], ["tracks", "error"])

    @F.pandas_udf(f"struct<tracks:{MEDIA},error:string>")
    def read(data):
        found = list(run(iter([pa.RecordBatch.from_arrays([pa.array(data, pa.binary())], ["data"])])))
        return pa.Table.from_batches(found).to_pandas() if found else pa.table({"tracks": pa.array([], _ARROW), "error": pa.array([], pa.string())}).to_pandas()

    found = files.withColumn(out, read(F.col(column).cast("binary")))
    return found.withColumn(f"{out}_error", F.col(f"{out}.error")).withColumn(out, F.col(f"{out}.tracks"))


_ARROW = pa.list_(pa.struct([
    ("handler", pa.string()), ("codec", pa.string()), ("timescale", pa.int64()), ("duration", pa.int64()), ("samples", pa.int64()),
    ("keyframes", pa.list_(pa.struct([("offset", pa.int64()), ("size", pa.int64())]))),
]))


def padded(text: bytes | None, unit: int = UNIT) -> bytes:
    """The text and spaces up to a positive multiple of ``unit`` bytes."""
    text = text or b""
    return text + b" " * (-len(text) % unit if text else unit)


def text_media(docs: DataFrame, unit: int = UNIT) -> DataFrame:
    """Each text of ``docs(doc_id, text)`` stored as a media file and read back.

    Returns ``doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, feature``.  Null and empty texts are one unit of
    spaces; equal texts have equal values; other columns are ignored.  The
    payload is read through the sample table; ``feature`` names codec, seconds,
    samples and keyframes, with the first and last keyframe's byte range.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = []
            for text in as_bytes(part.column(1)):
                media = pack(padded(text, unit), unit)
                (track,) = parse(media)
                payload = b"".join([media[o : o + s] for o, s in track.samples()])
                keys = track.keyframes()
                ticks = sum(n * d for n, d in track.times)
                feature = f"{track.handler}/{track.codec} {ticks / track.timescale:.6f}s samples={len(track.sizes)} keys={len(keys)} first={keys[0][0]}+{keys[0][1]} last={keys[-1][0]}+{keys[-1][1]}"
                rows.append((len(text or b""), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(list(c)) for c in zip(*rows))], NAMES)

    NAMES = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = ["long", "long", "long", "string", "long", "long", "string", "string"]
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(NAMES, kinds)))
