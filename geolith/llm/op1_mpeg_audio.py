"""MPEG audio: frames that carry bytes, and a reader that resynchronises, verifies and indexes them.

The writer makes a variable-bitrate MPEG-1 Layer III stream (48 kHz, mono, checksums on): an ID3v2
tag, a frame with the table of the variable bitrate, then frames of silence whose ancillary bytes are
the payload, 192 bytes to a unit and up to four units to a frame. The reader takes streams of Layers I to III
with tags of all versions and both kinds of tables; it verifies the checksums of Layer III and holds tables
against the frames that it finds.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field as attribute

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from geolith.llm.batches import field, id_and_text, map_batches

UNIT = 192
# Fixed values of the format: kbit/s by index for Layers III, II and I of MPEG-1, for Layers III and II and for Layer I of
# MPEG-2 and 2.5, Hz by index, polynomial.
KBITS_1 = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
KBITS_1_II = (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384)
KBITS_1_I = (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448)
KBITS_2 = (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)
KBITS_2_I = (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256)
HERTZ = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
POLYNOMIAL = 0x8005
#: Bitrate index for 1, 2, 3 and 4 units in a frame at 48 kHz: 240, 480, 672 and 960 bytes.
INDEX_OF_UNITS = (None, 6, 10, 12, 14)


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32) << 8
    for _ in range(8):
        table = np.where(table & 0x8000, (table << 1) ^ POLYNOMIAL, table << 1) & 0xFFFF
    return table.astype(np.uint16)


CRC = _crc_table()


def crc16(rows: np.ndarray) -> np.ndarray:
    """The frame checksum of each row of bytes."""
    crc = np.full(len(rows), 0xFFFF, np.uint16)
    for column in rows.T:
        crc = (crc << np.uint16(8)) ^ CRC[(crc >> np.uint16(8)) ^ column]
    return crc


def header(index: int) -> bytes:
    """MPEG-1 Layer III with a checksum, 48 kHz, mono."""
    return bytes([0xFF, 0xFA, index << 4 | 1 << 2, 0xC0])


def frame_start(index: int) -> bytes:
    """Header, checksum and the side information of a silent mono frame."""
    side = bytes(17)
    protected = np.frombuffer(header(index)[2:] + side, np.uint8)[None, :]
    return header(index) + struct.pack(">H", int(crc16(protected)[0])) + side


STARTS = {units: frame_start(index) for units, index in enumerate(INDEX_OF_UNITS) if index}
FRAME_BYTES = {units: 3 * KBITS_1[index] for units, index in enumerate(INDEX_OF_UNITS) if index}
OVERHEAD = len(STARTS[1])


def synchsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def write(text: bytes) -> tuple[bytes, int]:
    """The stream of a text padded with spaces to a positive multiple of 192 bytes, and the padded length."""
    payload = text.ljust(-(-max(1, len(text)) // UNIT) * UNIT, b" ")
    units = len(payload) // UNIT
    fours, rest = divmod(units, 4)
    body = np.zeros((fours, FRAME_BYTES[4]), np.uint8)
    if fours:
        body[:, :OVERHEAD] = np.frombuffer(STARTS[4], np.uint8)
        body[:, OVERHEAD : OVERHEAD + 4 * UNIT] = np.frombuffer(payload, np.uint8)[: fours * 4 * UNIT].reshape(fours, -1)
    tail = (STARTS[rest] + payload[fours * 4 * UNIT :]).ljust(FRAME_BYTES[rest], b"\0") if rest else b""
    frames = fours + bool(rest)
    table_frame = FRAME_BYTES[2]
    total = table_frame + body.nbytes + len(tail)
    sizes = np.full(frames + 1, FRAME_BYTES[4])
    sizes[0] = table_frame
    if rest:
        sizes[-1] = len(tail)
    starts = np.cumsum(sizes) - sizes
    toc = starts[np.minimum(np.arange(100) * (frames + 1) // 100, frames)] * 256 // total
    table = b"Xing" + struct.pack(">III", 7, frames, total) + np.minimum(toc, 255).astype(np.uint8).tobytes()
    first = (STARTS[2] + table).ljust(table_frame, b"\0")
    length = b"\0" + str(24 * frames).encode()
    size = b"\0" + str(len(payload)).encode()
    tags = b"".join(name + struct.pack(">I", len(value)) + b"\0\0" + value for name, value in ((b"TLEN", length), (b"TXXX", b"\0payload" + size)))
    return b"ID3\3\0\0" + synchsafe(len(tags)) + tags + first + body.tobytes() + tail, len(payload)


@dataclass
class Stream:
    """What the reader finds."""

    tags: dict[str, str] = attribute(default_factory=dict)
    table: dict[str, int] | None = None
    toc: bytes = b""
    table_at: int = 0
    end: int = 0
    table_fits: bool | None = None
    toc_fits: bool | None = None
    offsets: list[int] = attribute(default_factory=list)
    sizes: list[int] = attribute(default_factory=list)
    hertz: int = 0
    samples: int = 0
    skipped: int = 0
    resyncs: int = 0
    bad_checksums: int = 0
    checked: int = 0
    unchecked: int = 0
    bitrates: tuple[int, ...] = ()
    ancillary: list[tuple[int, int]] = attribute(default_factory=list)


_headers: dict[bytes, tuple | None] = {}


def parse_header(four: bytes) -> tuple | None:
    """(bytes of the frame, samples, Hz, kbit/s, bytes of side information, whether a checksum follows, layer), or None."""
    if four in _headers:
        return _headers[four]
    out = None
    if len(four) == 4 and four[0] == 0xFF and four[1] >> 5 == 7:
        version, layer, protection = four[1] >> 3 & 3, 4 - (four[1] >> 1 & 3), not four[1] & 1
        bitrate, rate, padding, mode = four[2] >> 4, four[2] >> 2 & 3, four[2] >> 1 & 1, four[3] >> 6
        if version != 1 and layer < 4 and 0 < bitrate < 15 and rate < 3:
            first = {1: KBITS_1_I, 2: KBITS_1_II, 3: KBITS_1}[layer] if version == 3 else KBITS_2_I if layer == 1 else KBITS_2
            kbits, hertz = first[bitrate], HERTZ[version][rate]
            samples = 384 if layer == 1 else 576 if layer == 3 and version != 3 else 1152
            side = 0 if layer < 3 else (17 if mode == 3 else 32) if version == 3 else (9 if mode == 3 else 17)
            size = (12 * kbits * 1000 // hertz + padding) * 4 if layer == 1 else samples // 8 * kbits * 1000 // hertz + padding
            out = size, samples, hertz, kbits, side, protection, layer
    if len(_headers) < 4096:
        _headers[four] = out
    return out


def synchsafe_value(four: bytes) -> int:
    return sum((b & 0x7F) << 7 * k for k, b in enumerate(reversed(four)))


def tag_text(value: bytes) -> str:
    """A text frame by its encoding byte; parts are joined by ``=``."""
    kind = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(value[0] if value else 0, "latin-1")
    return "=".join(x.lstrip("\ufeff") for x in value[1:].decode(kind, "replace").rstrip("\0").split("\0"))


def read_tags(media: bytes, found: Stream) -> int:
    """The ID3v2 tag of version 2, 3 or 4 at the start of a stream, and where it ends."""
    if media[:3] != b"ID3" or len(media) < 10:
        return 0
    version, flags, size = media[3], media[5], synchsafe_value(media[6:10])
    end = min(len(media), 10 + size)
    body = media[10:end]
    if flags & 0x80 and version < 4:
        body = body.replace(b"\xff\0", b"\xff")
    k = 0
    if flags & 0x40 and version > 2 and len(body) >= 4:  # the extended header; its own size counts in version 4 only
        k = synchsafe_value(body[:4]) if version == 4 else 4 + int.from_bytes(body[:4], "big")
    name, head = (3, 6) if version == 2 else (4, 10)
    while k + head <= len(body) and body[k : k + name].isalnum():
        field = body[k + name : k + name + (3 if version == 2 else 4)]
        length = synchsafe_value(field) if version == 4 else int.from_bytes(field, "big")
        value = body[k + head : k + head + length]
        if version == 4 and body[k + 9] & 2:
            value = value.replace(b"\xff\0", b"\xff")
        if version == 4 and body[k + 9] & 1:  # a data length indicator comes first
            value = value[4:]
        key = body[k : k + name].decode("ascii")
        found.tags[key] = tag_text(value) if key[0] == "T" else value.hex()
        k += head + length
    return min(len(media), end + 10 * bool(flags & 0x10 and version == 4))


def read_table(media: bytes, at: int, data: int, found: Stream) -> bool:
    """Whether the frame at ``at``, whose audio begins at ``data``, holds a table of the variable bitrate, which is then read."""
    if media[data : data + 4] in (b"Xing", b"Info"):
        flags, k, found.table = int.from_bytes(media[data + 4 : data + 8], "big"), data + 8, {}
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                found.table[name], k = int.from_bytes(media[k : k + 4], "big"), k + 4
        if flags & 4:
            found.toc = media[k : k + 100]
    elif media[at + 36 : at + 40] == b"VBRI":
        length, frames = (int.from_bytes(media[at + k : at + k + 4], "big") for k in (46, 50))
        entries, scale, width, step = (int.from_bytes(media[at + k : at + k + 2], "big") for k in (54, 56, 58, 60))
        found.table = {"frames": frames, "bytes": length, "step": step}
        for i in range(min(entries, max(0, len(media) - at - 62) // max(1, width))):
            found.table[f"entry{i}"] = int.from_bytes(media[at + 62 + i * width : at + 62 + (i + 1) * width], "big") * scale
    else:
        return False
    found.table_at = at
    return True


def check_table(found: Stream) -> None:
    """Hold the table's counts, and its places, against the frames."""
    if found.table is None:
        return
    total, n = found.end - found.table_at, len(found.offsets)
    found.table_fits = found.table.get("frames", n) == n and found.table.get("bytes", total) == total
    places = [at - found.table_at for at in [found.table_at, *found.offsets]]
    if found.toc and total:
        expected = [min(255, places[min(n, k * (n + 1) // 100)] * 256 // total) for k in range(100)]
        found.toc_fits = len(found.toc) == 100 and all(abs(a - b) <= 1 for a, b in zip(found.toc, expected, strict=True))
    elif step := found.table.get("step"):
        sizes = [found.table[k] for k in found.table if k.startswith("entry")]
        edges = [*found.offsets[::step], found.end]
        found.toc_fits = sizes == [b - a for a, b in zip(edges[:-1], edges[1:], strict=True)]


def read(media: bytes) -> Stream:
    """Tags, table, frames and checks of a stream; junk between frames is skipped and counted."""
    found, n = Stream(), len(media)
    at = read_tags(media, found)
    if n >= at + 128 and media[n - 128 : n - 125] == b"TAG":
        found.tags["ID3v1"] = media[n - 125 : n - 95].rstrip(b"\0 ").decode("latin-1")
        n -= 128
    checks: dict[tuple[int, bool], list[int]] = {}
    rates, lost = set(), False
    while at + 4 <= n:
        head = parse_header(media[at : at + 4])
        if head and at + head[0] <= n and (not lost and found.offsets or at + head[0] + 4 > n or parse_header(media[at + head[0] : at + head[0] + 4])):
            size, samples, hertz, kbits, side, protected, layer = head
            data = at + 4 + 2 * protected + side
            if found.offsets or found.table is not None or not read_table(media, at, data, found):
                found.offsets.append(at)
                found.sizes.append(size)
                found.samples += samples
                found.hertz = hertz
                rates.add(kbits)
                found.ancillary.append((data, at + size))
            if protected and layer == 3:
                checks.setdefault(side, []).append(at)
            found.unchecked += protected and layer < 3
            found.end = at + size
            found.resyncs += lost
            lost, at = False, at + size
        else:
            lost = True
            following = media.find(b"\xff", at + 1, n)
            step = following if following >= 0 else n
            found.skipped += step - at
            at = step
    found.skipped += n - at
    view = np.frombuffer(media, np.uint8)
    for side, starts in checks.items():
        places = np.array(starts)[:, None]
        crc = crc16(view[places + np.concatenate([[2, 3], 6 + np.arange(side)])])
        stored = view[places[:, 0] + 4].astype(np.uint16) << np.uint16(8) | view[places[:, 0] + 5]
        found.checked += len(starts)
        found.bad_checksums += int((crc != stored).sum())
    found.bitrates = tuple(sorted(rates))
    check_table(found)
    return found


def payload(media: bytes, stream: Stream) -> bytes:
    """The payload that :func:`write` stored."""
    size = int(stream.tags["TXXX"].partition("=")[2])
    whole = min(len(stream.ancillary), size // (4 * UNIT))
    out = b"".join(media[a : a + 4 * UNIT] for a, _ in stream.ancillary[:whole])
    if len(out) < size:
        a, end = stream.ancillary[whole]
        out += media[a : min(end, a + size - len(out))]
    return out


def feature(stream: Stream) -> str:
    """Duration as a fraction of seconds, frames, rates, checks and a digest of the seek offsets."""
    seek = zlib.crc32(np.array(stream.offsets, "<u8").tobytes())
    rates = "/".join(map(str, stream.bitrates))
    table = stream.table or {}
    return f"samples={stream.samples}/{stream.hertz};frames={len(stream.offsets)};kbits={rates};table={table.get('frames', -1)},{table.get('bytes', -1)};table_fits={stream.table_fits};toc_fits={stream.toc_fits};crc_bad={stream.bad_checksums}/{stream.checked};resync={stream.resyncs};seek_crc32={seek:08x}"


def store_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = False) -> DataFrame:
    """One row per input row: the id, ``n_bytes``, ``payload_bytes``, ``payload_sha256``, ``tail_crc32``, ``media_bytes``, ``media_sha256``, ``feature``, ``samples``, ``hertz``, ``frame_offsets``; with ``keep_media`` also ``media``.

    The payload's columns come from bytes read back from the stored stream. A null or empty text is
    192 spaces. The exact duration is ``samples`` / ``hertz`` seconds; ``frame_offsets`` has where each frame
    with sound begins. Repeated rows and ids give repeated rows, a null id stays null, other columns are
    ignored, an empty table gives an empty one. Texts are stored whole, whatever their length.
    """
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "samples", "hertz", "frame_offsets", "media"]
    kinds = [T.LongType(), T.LongType(), T.StringType(), T.LongType(), T.LongType(), T.StringType(), T.StringType(), T.LongType(), T.LongType(), T.ArrayType(T.LongType()), T.BinaryType()]
    arrow = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
    used = len(names) - (not keep_media)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for text in batch.column(1).to_pylist():
                own = (text or "").encode()
                media, _ = write(own)
                stream = read(media)
                back = payload(media, stream)
                rows.append((len(own), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(stream), stream.samples, stream.hertz, stream.offsets, media)[:used])
            columns = list(zip(*rows, strict=True)) if rows else [()] * used
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, arrow, strict=False))], names=[id_col, *names[:used]])

    return map_batches(id_and_text(df, id_col, text_col), work, [field(df, id_col), *(T.StructField(n, k) for n, k in zip(names[:used], kinds, strict=False))])


def read_media(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """The index of any stored streams: the id, ``samples``, ``hertz``, ``n_frames``, ``n_skipped``, ``n_resyncs``, ``n_bad_checksums``, ``n_unchecked``, ``table_fits``, ``toc_fits``, ``tags``, ``frame_offsets``.

    A null, empty or foreign stream has no frames and all its bytes skipped. ``n_unchecked`` are the frames of
    Layers I and II with a checksum; the two flags are null without a table or its places.
    """
    names, flags = ["samples", "hertz", "n_frames", "n_skipped", "n_resyncs", "n_bad_checksums", "n_unchecked"], ["table_fits", "toc_fits"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [read(x or b"") for x in batch.column(1).to_pylist()]
            longs = [(s.samples, s.hertz, len(s.offsets), s.skipped, s.resyncs, s.bad_checksums, s.unchecked) for s in found]
            columns = [pa.array([r[i] for r in longs], pa.int64()) for i in range(len(names))]
            columns += [pa.array([getattr(s, f) for s in found], pa.bool_()) for f in flags]
            tags = pa.array([list(s.tags.items()) for s in found], pa.map_(pa.string(), pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, tags, pa.array([s.offsets for s in found], pa.list_(pa.int64()))], names=[id_col, *names, *flags, "tags", "frame_offsets"])

    fields = [field(df, id_col), *(T.StructField(n, T.LongType()) for n in names), *(T.StructField(f, T.BooleanType()) for f in flags), T.StructField("tags", T.MapType(T.StringType(), T.StringType())), T.StructField("frame_offsets", T.ArrayType(T.LongType()))]
    return map_batches(id_and_text(df, id_col, media_col), work, fields)
