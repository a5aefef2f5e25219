"""MPEG audio columns: a writer that carries any bytes in layer III frames, and a parser for any stream of any layer.

The writer makes an ID3v2.4 tag, a variable-bitrate table frame (``Xing``: frames, bytes, seek table) and MPEG-1 layer III
frames at 48 kHz with header checksums. Their side information is all zero: no bits of main data, so that a decoder plays silence. The payload lies behind it,
in the frames' ancillary data, byte by byte, all frames full but the last, which takes the smallest bitrate that holds its rest; the tag
holds its length and CRC-32.

The parser reads ID3v2.2, 2.3 and 2.4 tags (extended headers, unsynchronisation, compressed frames, all text encodings) and ID3v1, finds frame
headers again after junk (there a header counts only if another valid header or the end of the audio follows the frame; right after a frame
any valid header counts), reads ``Xing``, ``Info`` and ``VBRI`` tables, verifies the CRC-16 of protected frames (layer I: allocation; layer II: allocation
and scale factor selection; layer III: side information) and the tag's CRC-32 of the payload, and gives exact durations (samples over
rate) and the byte offset of every frame for seeking. It takes any bytes: what is cut off or contradicts itself is left out.

Defined results: null payloads are stored as empty ones by `payload_of` (padded like any other);
a stream without frames has 0 frames, duration 0 and no payload. Null ids and repeated rows pass through; other columns play no part; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazmill.llm.common import released, slices, texts_of

# Fixed values of the format: bitrates (kbit/s) and sampling rates (Hz) by version and layer, samples a frame.
BITRATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
SAMPLES = {(1, 1): 384, (1, 2): 1152, (1, 3): 1152, (2, 1): 384, (2, 2): 1152, (2, 3): 576}

# Fixed values of layer II: bits of allocation for each subband, by table; the fields of an ID3v1 tag; text encodings of ID3v2.
ALLOCATION = {"a": [4] * 11 + [3] * 12 + [2] * 4, "b": [4] * 11 + [3] * 12 + [2] * 7, "c": [4] * 2 + [3] * 6, "d": [4] * 2 + [3] * 10, "lsf": [4] * 4 + [3] * 7 + [2] * 19}
V1_FIELDS = (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("year", 93, 97), ("comment", 97, 127))
ENCODINGS = {0: ("latin-1", b"\0"), 1: ("utf-16", b"\0\0"), 2: ("utf-16-be", b"\0\0"), 3: ("utf-8", b"\0")}

RATE, SIDE, HEAD = 48000, 32, 4 + 2
UNIT = 64


def _crc_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32) << 8
    for _ in range(8):
        out = np.where(out & 0x8000, (out << 1) ^ 0x8005, out << 1) & 0xFFFF
    return out


_CRC = _crc_table()


def crc16(rows: np.ndarray) -> np.ndarray:
    """CRC-16 (0x8005, start 0xFFFF) of each row of bytes."""
    crc = np.full(len(rows), 0xFFFF, dtype=np.uint32)
    for k in range(rows.shape[1]):
        crc = ((crc << 8) & 0xFFFF) ^ _CRC[(crc >> 8) ^ rows[:, k]]
    return crc


def crc16_bits(data: bytes, bits: int) -> int:
    """The same checksum over so many bits."""
    crc = int(crc16(np.frombuffer(data[: bits // 8], dtype=np.uint8)[None])[0])
    for k in range(bits // 8 * 8, bits):
        bit = data[k >> 3] >> (7 - (k & 7)) & 1
        crc = ((crc << 1) & 0xFFFF) ^ (0x8005 if (crc >> 15) ^ bit else 0)
    return crc


def header(bitrate_index: int) -> bytes:
    """MPEG-1, layer III, with checksum, 48 kHz, no padding, stereo."""
    return bytes([0xFF, 0xFA, bitrate_index << 4 | 1 << 2, 0])


def frame_bytes(kbps: int) -> int:
    return 144 * kbps * 1000 // RATE


_FULL = 14
_ROOM = [frame_bytes(k) - HEAD - SIDE if k else -1 for k in BITRATES[1, 3]]


def frames_for(payload: bytes) -> tuple[bytes, list[int]]:
    """The audio frames that hold a payload, and each one's size."""
    room = _ROOM[_FULL]
    full, rest = divmod(len(payload), room)
    out, sizes = [], []

    def make(index: int, data: np.ndarray, used: int) -> np.ndarray:
        n = len(data)
        frame = np.zeros((n, frame_bytes(BITRATES[1, 3][index])), dtype=np.uint8)
        frame[:, :4] = np.frombuffer(header(index), dtype=np.uint8)
        frame[:, HEAD + SIDE : HEAD + SIDE + used] = data
        crc = crc16(np.concatenate([frame[:, 2:4], frame[:, HEAD : HEAD + SIDE]], axis=1))
        frame[:, 4], frame[:, 5] = crc >> 8, crc & 0xFF
        return frame

    raw = np.frombuffer(payload, dtype=np.uint8)
    if full:
        frames = make(_FULL, raw[: full * room].reshape(full, room), room)
        out.append(frames.tobytes())
        sizes += [frames.shape[1]] * full
    if rest:
        index = next(i for i, r in enumerate(_ROOM) if r >= rest)
        frame = make(index, raw[full * room :].reshape(1, rest), rest)
        out.append(frame.tobytes())
        sizes.append(frame.shape[1])
    return b"".join(out), sizes


def _synchsafe(n: int) -> bytes:
    return bytes((n >> s) & 0x7F for s in (21, 14, 7, 0))


def _text_frame(name: str, value: str) -> bytes:
    body = b"\x03" + name.encode() + b"\0" + value.encode()
    return b"TXXX" + _synchsafe(len(body)) + b"\0\0" + body


def write(payload: bytes) -> bytes:
    """The file: tag, table frame, audio frames. The tag holds the payload's length and CRC-32."""
    audio, sizes = frames_for(payload)
    tag = _text_frame("payload_bytes", str(len(payload))) + _text_frame("payload_crc32", f"{zlib.crc32(payload):08x}")
    tag = b"ID3\x04\0\0" + _synchsafe(len(tag)) + tag
    index = 9
    table = bytearray(frame_bytes(BITRATES[1, 3][index]))
    table[:4] = header(index)
    ends = np.cumsum([0, *sizes])
    at = [len(sizes) * k // 100 for k in range(100)]
    total = len(audio) + len(table)
    toc = bytes(min(255, int(ends[i] + len(table)) * 256 // total) for i in at)
    body = b"Xing" + struct.pack(">III", 7, len(sizes), total) + toc
    table[HEAD + SIDE : HEAD + SIDE + len(body)] = body
    crc = int(crc16(np.frombuffer(bytes(table[2:4] + table[HEAD : HEAD + SIDE]), dtype=np.uint8)[None])[0])
    table[4:6] = struct.pack(">H", crc)
    return tag + bytes(table) + audio


@dataclass
class Parsed:
    tags: dict[str, str] = field(default_factory=dict)
    table: dict | None = None
    offsets: list[int] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    samples: int = 0
    duration: float = 0.0
    checked: int = 0
    bad_crc: int = 0
    resyncs: int = 0
    payload: bytes = b""
    payload_ok: bool | None = None


@dataclass(frozen=True)
class Head:
    """What a frame's header says."""

    size: int
    samples: int
    rate: int
    side: int
    checked: bool
    version: int
    layer: int
    channels: int
    bound: int
    kbps: int


def head(data: bytes, at: int) -> Head | None:
    """The frame header at a place, if it is valid."""
    if at + 4 > len(data) or data[at] != 0xFF or data[at + 1] & 0xE0 != 0xE0:
        return None
    version, layer, bits = data[at + 1] >> 3 & 3, 4 - (data[at + 1] >> 1 & 3), data[at + 2]
    if version == 1 or layer == 4 or bits >> 4 in (0, 15) or bits >> 2 & 3 == 3:
        return None
    family = 1 if version == 3 else 2
    rate, kbps = RATES[version][bits >> 2 & 3], BITRATES[family, layer][bits >> 4]
    samples, padding = SAMPLES[family, layer], bits >> 1 & 1
    size = (12 * kbps * 1000 // rate + padding) * 4 if layer == 1 else samples // 8 * kbps * 1000 // rate + padding
    mode, extension = data[at + 3] >> 6, data[at + 3] >> 4 & 3
    mono = mode == 3
    side = ((17 if mono else 32) if family == 1 else (9 if mono else 17)) if layer == 3 else 0
    return Head(size, samples, rate, side, not data[at + 1] & 1, version, layer, 1 if mono else 2, (extension + 1) * 4 if mode == 1 else 32, kbps)


def protected_bits(data: bytes, at: int, h: Head) -> int | None:
    """How many bits behind the checksum it covers; null if the frame ends before them."""
    if h.layer == 3:
        bits = 8 * h.side
    elif h.layer == 1:
        bits = 4 * (min(h.bound, 32) * h.channels + 32 - min(h.bound, 32)) if h.channels == 2 else 4 * 32
    else:
        each = h.kbps // h.channels
        kind = "lsf" if h.version != 3 else ("d" if h.rate == 32000 else "c") if each <= 48 else "a" if h.rate == 48000 or each <= 80 else "b"
        body = data[at + 6 : at + h.size]
        whole, length, bits, shares = int.from_bytes(body, "big"), 8 * len(body), 0, 0
        for band, wide in enumerate(ALLOCATION[kind]):
            own = h.channels if band < h.bound else 1
            for _ in range(own):
                if bits + wide > length:
                    return None
                used = whole >> (length - bits - wide) & ((1 << wide) - 1)
                shares += (h.channels // own) * (used > 0)
                bits += wide
        bits += 2 * shares
    return bits if 48 + bits <= 8 * h.size and at + 6 + (bits + 7) // 8 <= len(data) else None


def synchsafe(raw: bytes) -> int | None:
    return None if len(raw) < 4 or max(raw[:4]) > 0x7F else raw[0] << 21 | raw[1] << 14 | raw[2] << 7 | raw[3]


def _texts(body: bytes) -> list[str]:
    """The strings of a text frame."""
    if not body:
        return []
    name, stop = ENCODINGS.get(body[0], ENCODINGS[0])
    rest, parts = body[1:], []
    wide = len(stop)
    begin = at = 0
    while at + wide <= len(rest):
        if rest[at : at + wide] == stop:
            parts.append(rest[begin:at])
            begin = at + wide
        at += wide
    parts.append(rest[begin:])
    return [p.decode(name, "replace").lstrip("\ufeff") for p in parts]


def _frame_body(body: bytes, major: int, flags: int) -> bytes | None:
    """A frame's contents as they were before they were grouped, unsynchronised and compressed; null if they are encrypted or broken."""
    if major == 3:
        packed, secret, grouped, length, escaped = flags & 0x80, flags & 0x40, flags & 0x20, flags & 0x80, 0
    else:
        packed, secret, grouped, length, escaped = flags & 0x08, flags & 0x04, flags & 0x40, flags & 0x01, flags & 0x02
    if secret:
        return None
    body = body[1:] if grouped and major == 4 else body
    body = body[4:] if length else body
    body = body[1:] if grouped and major == 3 else body
    body = body.replace(b"\xff\0", b"\xff") if escaped else body
    if packed:
        try:
            body = zlib.decompressobj().decompress(body, 1 << 20)
        except zlib.error:
            return None
    return body


def read_id3v2(data: bytes, at: int, tags: dict[str, str]) -> int:
    """Reads the tag at a place into tags; where it ends (the place itself if there is none)."""
    size = synchsafe(data[at + 6 : at + 10])
    if data[at : at + 3] != b"ID3" or size is None or data[at + 3] not in (2, 3, 4):
        return at
    major, flags = data[at + 3], data[at + 5]
    body, end = data[at + 10 : at + 10 + size], at + 10 + size + (10 if major == 4 and flags & 0x10 else 0)
    if flags & 0x80 and major < 4:
        body = body.replace(b"\xff\0", b"\xff")
    spot = 0
    if flags & 0x40 and major > 2:
        more = synchsafe(body[:4]) if major == 4 else int.from_bytes(body[:4], "big") + 4
        spot = len(body) if more is None else more
    wide = 3 if major == 2 else 4
    while spot + 2 * wide <= len(body) and body[spot : spot + wide].isalnum():
        name = body[spot : spot + wide].decode("ascii", "replace")
        raw = body[spot + wide : spot + 2 * wide]
        n = synchsafe(raw) if major == 4 else int.from_bytes(raw, "big")
        start = spot + 2 * wide + (2 if major > 2 else 0)
        if n is None or start + n > len(body):
            break
        held = body[start : start + n] if major == 2 else _frame_body(body[start : start + n], major, body[start - 1])
        if held is not None and name[0] == "T":
            parts = _texts(held)
            if name in ("TXXX", "TXX"):
                if len(parts) > 1:
                    tags[parts[0]] = parts[1]
            elif parts:
                tags[name] = "; ".join(p for p in parts if p)
        spot = start + n
    return min(end, len(data))


def read_id3v1(raw: bytes, tags: dict[str, str]) -> None:
    numbered = raw[125] == 0 and raw[126] != 0
    for name, a, b in V1_FIELDS:
        value = raw[a : 125 if name == "comment" and numbered else b].split(b"\0")[0].decode("latin-1").strip()
        if value:
            tags[f"v1.{name}"] = value
    if numbered:
        tags["v1.track"] = str(raw[126])
    if raw[127] != 0xFF:
        tags["v1.genre"] = str(raw[127])


def read_table(frame: bytes, skip: int, side: int) -> dict | None:
    """The variable-bitrate table in a first frame: kind, and frames, bytes and toc as far as they are there."""

    def number(at: int, wide: int) -> int | None:
        return int.from_bytes(frame[at : at + wide], "big") if at + wide <= len(frame) else None

    at = skip + side
    if frame[at : at + 4] in (b"Xing", b"Info"):
        out: dict = {"kind": frame[at : at + 4].decode()}
        flags, spot = number(at + 4, 4) or 0, at + 8
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out[name] = number(spot, 4)
                spot += 4
        if flags & 4 and spot + 100 <= len(frame):
            out["toc"] = frame[spot : spot + 100]
        return out
    if frame[36:40] == b"VBRI":
        count, scale, wide, step = (number(54 + 2 * k, 2) or 0 for k in range(4))
        toc = [v * scale for k in range(count) if wide and (v := number(62 + k * wide, wide)) is not None]
        return {"kind": "VBRI", "bytes": number(46, 4), "frames": number(50, 4), "toc": toc, "step": step}
    return None


def parse(data: bytes) -> Parsed:
    got, at, end = Parsed(), 0, len(data)
    while (after := read_id3v2(data, at, got.tags)) > at:
        at = after
    if end - at >= 128 and data[end - 128 : end - 125] == b"TAG":
        read_id3v1(data[end - 128 :], got.tags)
        end -= 128
    heads: list[Head] = []
    known: dict[bytes, Head] = {}
    samples: dict[int, int] = {}
    first, synced, sure = True, True, False
    while at + 4 <= end:
        word = data[at : at + 4]
        h = known.get(word)
        if h is None and (h := head(data, at)):
            known[word] = h
        follows = h and h.size >= 4 and at + h.size <= end and (sure or at + h.size == end or head(data, at + h.size))
        if not follows:
            sure = False
            if synced:
                got.resyncs, synced = got.resyncs + 1, False
            at = data.find(b"\xff", at + 1, end)
            if at < 0:
                break
            continue
        synced = sure = True
        table = read_table(data[at : at + h.size], 4 + 2 * h.checked, h.side) if first and h.layer == 3 else None
        if table:
            got.table = table
        else:
            got.offsets.append(at)
            got.sizes.append(h.size)
            heads.append(h)
            samples[h.rate] = samples.get(h.rate, 0) + h.samples
        first = False
        at += h.size
    got.samples, got.duration = sum(samples.values()), sum(n / rate for rate, n in sorted(samples.items()))
    _check_frames(data, got, heads)
    _read_payload(data, got, heads)
    return got


def _check_frames(data: bytes, got: Parsed, heads: list[Head]) -> None:
    """Verify the checksums of all protected frames that hold what they protect."""
    raw = np.frombuffer(data, dtype=np.uint8)
    for side in {h.side for h in heads if h.checked and h.layer == 3}:
        at = np.array([o for o, h in zip(got.offsets, heads) if h.checked and h.layer == 3 and h.side == side and h.size >= 6 + side])
        if not len(at):
            continue
        rows = raw[at[:, None] + np.array([2, 3, *range(6, 6 + side)])]
        wrong = crc16(rows) != (raw[at + 4].astype(np.uint32) << 8 | raw[at + 5])
        got.checked += len(at)
        got.bad_crc += int(wrong.sum())
    for at, h in zip(got.offsets, heads):
        if h.checked and h.layer < 3 and (bits := protected_bits(data, at, h)) is not None:
            own = crc16_bits(data[at + 2 : at + 4] + data[at + 6 : at + 6 + (bits + 7) // 8], 16 + bits)
            got.checked += 1
            got.bad_crc += own != int.from_bytes(data[at + 4 : at + 6], "big")


def _read_payload(data: bytes, got: Parsed, heads: list[Head]) -> None:
    """What the frames' ancillary data hold, if the tag says how much."""
    told = got.tags.get("payload_bytes")
    if told is None:
        return
    view = memoryview(data)
    joined = b"".join(view[o + 4 + 2 * h.checked + h.side : o + h.size] for o, h in zip(got.offsets, heads) if h.layer == 3)
    n = int(told) if told.isascii() and told.isdigit() and len(told) < 19 else -1
    got.payload = joined[: max(0, n)]
    got.payload_ok = len(got.payload) == n and f"{zlib.crc32(got.payload):08x}" == got.tags.get("payload_crc32")


def payload_of(text: bytes) -> bytes:
    """The bytes with zeros appended up to a positive multiple of UNIT."""
    return text + bytes(UNIT - len(text) if not text else -len(text) % UNIT)


def features(got: Parsed) -> str:
    table = got.table or {}
    seek = hashlib.md5(np.array(got.offsets, dtype="<u8").tobytes()).hexdigest()[:16]
    return f"frames={len(got.offsets)};samples={got.samples};seconds={got.duration:.6f};checked={got.checked};bad={got.bad_crc};resyncs={got.resyncs};vbr={table.get('frames')};seek={seek};ok={got.payload_ok}"


def store(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes (unpadded), media: each text's bytes as an MPEG audio file."""

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            raw = [t.encode() for t in texts_of(batch.column("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([len(r) for r in raw], pa.int64()), pa.array([write(payload_of(r)) for r in raw], pa.binary())], ["key", "n_bytes", "media"])

    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(released(written), rows.select("key").schema.add("n_bytes", "long").add("media", "binary")).withColumnRenamed("key", key)


def read(df: DataFrame, keep: list[str], media: str = "media", with_offsets: bool = False) -> DataFrame:
    """The columns to keep, with payload and media sizes and digests, duration, feature and, if asked for, the seek offsets."""
    rows = df.select(*keep, F.col(media).cast("binary").alias("__media"))
    schema = df.select(*keep).schema.add("payload_bytes", "long").add("payload_sha256", "string").add("tail_crc32", "long").add("media_bytes", "long").add("media_sha256", "string").add("feature", "string").add("seconds", "double")
    if with_offsets:
        schema = schema.add("offsets", T.ArrayType(T.LongType()))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__media"):
            out, seen = [], {}
            for value in batch.column("__media"):
                data = value.as_py() or b""
                name = hashlib.sha256(data).hexdigest()
                if name not in seen:
                    got = parse(data)
                    p = got.payload
                    seen[name] = [len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-UNIT:]), len(data), name, features(got), got.duration] + [got.offsets] * with_offsets
                out.append(seen[name])
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array([x[k] for x in out], kinds[k]) for k in range(7 + with_offsets))], schema.fieldNames())

    return rows.mapInArrow(released(measured), schema)
