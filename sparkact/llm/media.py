"""MPEG audio columns: parse streams, and carry byte payloads in silent Layer III frames.

:func:`parse` resynchronises frame headers: a header counts where the next one, or the stream's
end, stands where its length says, or if it follows a frame and its own checksum holds. It parses
ID3v2 and ID3v1 tags and the Xing, Info and VBRI tables, verifies the 16-bit frame checksums of
all layers, and gives the exact duration as a fraction and the byte offset of every frame. Frames
of free format, whose headers don't tell their length, are skipped.

:func:`wrap` stores a payload losslessly: an ID3v2 tag with the payload's length and crc32,
a frame with a Xing table, then frames whose side information is zero (silence), so that the
bytes behind it are ancillary data. :func:`unwrap` reads the payload back.

Defined results: null bytes or texts count as empty; a stream without frames has duration 0 and
no offsets; garbage between frames is skipped and counted. Each row, repeated or not, has its own
result, an empty table none; columns other than the named ones are not read.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left
from fractions import Fraction
from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed values of the MPEG audio formats: kbit/s by (version 1, layer) or (versions 2 and 2.5, layer); Hz by version.
KBPS = {
    (1, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
HZ = {1: (44100, 48000, 32000), 2: (22050, 24000, 16000), 25: (11025, 12000, 8000)}
CRC_POLYNOMIAL = 0x8005
# Layer II: bits of the allocation of each subband, as (subbands, bits), by table.
ALLOCATION = {
    "a": ((11, 4), (12, 3), (4, 2)),
    "b": ((11, 4), (12, 3), (7, 2)),
    "c": ((2, 4), (6, 3)),
    "d": ((2, 4), (10, 3)),
    "lsf": ((4, 4), (7, 3), (19, 2)),
}


@lru_cache(4096)
def header(four: bytes) -> tuple | None:
    """(version, layer, kbit/s, Hz, frame bytes, samples, checksum there, side bytes) or None."""
    b = int.from_bytes(four, "big")
    if len(four) < 4 or b >> 21 != 0x7FF:
        return None
    version, layer = {3: 1, 2: 2, 0: 25}.get(b >> 19 & 3), 4 - (b >> 17 & 3)
    rate, hz, pad = b >> 12 & 15, b >> 10 & 3, b >> 9 & 1
    if version is None or layer == 4 or hz == 3 or rate in (0, 15):
        return None
    kbps, hz = KBPS[min(version, 2), layer][rate - 1], HZ[version][hz]
    samples = 384 if layer == 1 else 1152 if layer == 2 or version == 1 else 576
    size = (12 * kbps * 1000 // hz + pad) * 4 if layer == 1 else samples // 8 * kbps * 1000 // hz + pad
    mono = b >> 6 & 3 == 3
    side = (17 if mono else 32) if version == 1 else (9 if mono else 17)
    return version, layer, kbps, hz, size, samples, not b >> 16 & 1, side if layer == 3 else 0


@lru_cache(4096)
def crc16(data: bytes, bits: int | None = None) -> int:
    """The checksum of the first ``bits`` of ``data`` (all by default)."""
    c = 0xFFFF
    for i in range(8 * len(data) if bits is None else bits):
        c ^= (data[i >> 3] >> 7 - (i & 7) & 1) << 15
        c = (c << 1 ^ CRC_POLYNOMIAL if c & 0x8000 else c << 1) & 0xFFFF
    return c


def protected_bits(frame: bytes) -> int:
    """How many bits behind the checksum it covers, besides the last 16 of the header: the side
    information of Layer III, the allocation of Layer I, allocation and scale factor selection of
    Layer II."""
    version, layer, kbps, hz, _, _, _, side = header(frame[:4])
    if layer == 3:
        return 8 * side
    mode = frame[3] >> 6
    channels, bound = (1, 32) if mode == 3 else (2, 4 * (frame[3] >> 4 & 3) + 4 if mode == 1 else 32)
    if layer == 1:
        return 4 * (channels * bound + 32 - bound) if channels == 2 else 128
    each = kbps // channels
    kind = "lsf" if version != 1 else ("d" if hz == 32000 else "c") if each < 56 else "a" if hz == 48000 or each < 96 else "b"
    body, at, chosen, subband = int.from_bytes(frame[6:], "big"), 0, 0, 0
    total = 8 * (len(frame) - 6)
    for count, width in ALLOCATION[kind]:
        for _ in range(count):
            own = channels if subband < bound else 1
            for _ in range(own):
                used = body >> max(0, total - at - width) & (1 << width) - 1
                chosen += bool(used) * (channels if own < channels else 1)
                at += width
            subband += 1
    return min(at + 2 * chosen, total)


def intact(frame: bytes) -> bool:
    """Whether a protected frame's checksum holds."""
    bits = protected_bits(frame)
    return len(frame) > 6 and crc16(frame[2:4] + frame[6 : 6 + -(-bits // 8)], 16 + bits) == int.from_bytes(frame[4:6], "big")


def id3v2(data: bytes) -> tuple[int, dict[str, bytes]]:
    """The tag's bytes and its frames by identifier (versions 2.3 and 2.4)."""
    if data[:3] != b"ID3" or len(data) < 10 or max(data[6:10]) > 127:
        return 0, {}
    whole = lambda x: x[0] << 21 | x[1] << 14 | x[2] << 7 | x[3]
    end, at, frames = min(10 + whole(data[6:10]), len(data)), 10, {}
    while at + 10 <= end and data[at : at + 4].isalnum():
        size = whole(data[at + 4 : at + 8]) if data[3] == 4 else int.from_bytes(data[at + 4 : at + 8], "big")
        frames.setdefault(data[at : at + 4].decode("ascii"), data[at + 10 : min(at + 10 + size, end)])
        at += 10 + size
    return end, frames


def vbr_table(frame: bytes, side: int) -> dict | None:
    """The Xing, Info or VBRI table of the first frame."""
    for at in (4 + side, 6 + side):
        if (kind := frame[at : at + 4]) in (b"Xing", b"Info"):
            flags, at, out = int.from_bytes(frame[at + 4 : at + 8], "big"), at + 8, {"kind": kind.decode()}
            for bit, name in ((1, "frames"), (2, "bytes")):
                if flags & bit:
                    out[name] = int.from_bytes(frame[at : at + 4], "big")
                    at += 4
            if flags & 4:
                out["toc"], at = list(frame[at : at + 100]), at + 100
            if flags & 8:
                out["quality"] = int.from_bytes(frame[at : at + 4], "big")
            return out
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        quality, size, count, entries, scale, width, per = struct.unpack(">HIIHHHH", frame[44:62])
        table = [scale * int.from_bytes(frame[62 + i * width : 62 + (i + 1) * width], "big") for i in range(entries)]
        return {"kind": "VBRI", "bytes": size, "frames": count, "quality": quality, "toc": table, "frames_per_entry": per}
    return None


def parse(data: bytes | None) -> dict:
    """What the module's docstring names, of one stream."""
    data = data or b""
    start, tags = id3v2(data)
    whole = scanned(data, start, len(data), tags)
    if data[-128:-125] != b"TAG" or inside_frames(whole, len(data)):
        return whole
    return scanned(data, start, len(data) - 128, tags)


def inside_frames(parsed: dict, end: int) -> bool:
    """Whether the place of an ID3v1 tag lies in the data of frames that follow one another up to
    the stream's end."""
    tag = end - 128
    for o, n in zip(reversed(parsed["offsets"]), reversed(parsed["sizes"]), strict=True):
        if o + n != end or end <= tag:
            return False
        if o < tag:
            return True
        end = o
    return False


def scanned(data: bytes, start: int, end: int, tags: dict[str, bytes]) -> dict:
    """The frames between ``start`` and ``end``."""
    offsets, skipped, wrong, checked, table, samples, hz = [], 0, 0, 0, None, Fraction(0), set()
    at, sizes = start, []
    while at + 4 <= end:
        h = header(data[at : at + 4])
        after = h and at + h[4]
        sure = h and after <= end and (after == end or (n := header(data[after : after + 4])) and n[:2] == h[:2])
        holds = h and h[6] and after <= end and intact(data[at:after])
        if sure or holds and offsets and offsets[-1] + sizes[-1] == at:
            version, layer, kbps, rate, size, count, protected, side = h
            checked += protected
            wrong += protected and not holds
            if not offsets:
                table = vbr_table(data[at:after], side)
            if offsets or not table:
                samples += Fraction(count, rate)
            offsets.append(at)
            sizes.append(size)
            hz.add(rate)
            at = after
        else:
            to = data.find(b"\xff", at + 1, end)
            skipped += (end if to < 0 else to) - at
            at = end if to < 0 else to
    return {"tags": tags, "offsets": offsets, "sizes": sizes, "skipped": skipped, "checksums": checked, "checksums_wrong": wrong, "vbr": table, "seconds": samples, "hz": sorted(hz), "audio_start": start, "id3v1": end < len(data)}


HEAD, SIDE = 6, 17  # header and checksum; mono side information
RATES = KBPS[1, 3]
ROOM = [3 * k - HEAD - SIDE for k in RATES]  # at 48 kHz a frame has three bytes for each kbit/s
OWNER = b"sparkact.payload\0"


@lru_cache(64)
def silent(rate: int) -> bytes:
    """Header, checksum and side information of a silent mono frame at 48 kHz."""
    head = bytes([0xFF, 0xFA, rate + 1 << 4 | 1 << 2, 0xC0])
    return head + crc16(head[2:] + bytes(SIDE)).to_bytes(2, "big") + bytes(SIDE)


def wrap(payload: bytes) -> bytes:
    full, top = len(payload) // ROOM[-1], len(RATES) - 1
    parts = [silent(top) + payload[i * ROOM[-1] : (i + 1) * ROOM[-1]] for i in range(full)]
    if rest := payload[full * ROOM[-1] :]:
        rate = bisect_left(ROOM, len(rest))
        parts.append(silent(rate) + rest + bytes(ROOM[rate] - len(rest)))
    first = 4  # 64 kbit/s: room for the table
    total = 3 * RATES[first] + sum(map(len, parts))
    ends, at = [0], 3 * RATES[first]
    for p in parts:
        ends.append(at)
        at += len(p)
    toc = bytes(min(255, 256 * ends[len(ends) * i // 100] // total) for i in range(100))
    table = b"Xing" + struct.pack(">III", 15, len(parts), total) + toc + struct.pack(">I", 0)
    frame = silent(first) + table
    note = OWNER + struct.pack(">QI", len(payload), zlib.crc32(payload))
    private = b"PRIV" + struct.pack(">IH", len(note), 0) + note
    n = len(private)
    tag = b"ID3\x03\x00\x00" + bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127]) + private
    return tag + frame + bytes(3 * RATES[first] - len(frame)) + b"".join(parts)


def unwrap(data: bytes, parsed: dict) -> bytes:
    """The payload of :func:`wrap`; raises ValueError if it isn't whole."""
    note = parsed["tags"].get("PRIV", b"")
    if not note.startswith(OWNER):
        raise ValueError("no payload tag")
    size, crc = struct.unpack(">QI", note[len(OWNER) :])
    skip = HEAD + SIDE
    out = b"".join(data[o + skip : o + n] for o, n in zip(parsed["offsets"][1:], parsed["sizes"][1:], strict=True))[:size]
    if len(out) != size or zlib.crc32(out) != crc or parsed["checksums_wrong"]:
        raise ValueError("the stored payload is damaged")
    return out


def feature(parsed: dict) -> str:
    """Exact duration, frames, resynchronised bytes and seek offsets as text."""
    s, offsets = parsed["seconds"], parsed["offsets"]
    return f"duration={s.numerator}/{s.denominator};frames={len(offsets)};checked={parsed['checksums']};wrong={parsed['checksums_wrong']};skipped={parsed['skipped']};vbr={(parsed['vbr'] or {}).get('kind', '-')};seek={','.join(map(str, offsets))}"


def batched(batches, row, schema: pa.Schema, size: int = 256):
    """Arrow batches of ``row(*values)`` for each row; few rows at a time, so that memory stays bounded."""
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            part = batch.slice(at, size)
            rows = [row(*x) for x in zip(*[c.to_pylist() for c in part.columns], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema) if rows else pa.RecordBatch.from_pylist([], schema=schema)


def described(df: DataFrame, data: str, key: str) -> DataFrame:
    """Facts of an MPEG audio binary column: key, exact seconds as a fraction, frames, offsets."""
    schema = pa.schema([("key", pa.int64()), ("seconds_num", pa.int64()), ("seconds_den", pa.int64()), ("frame_offsets", pa.list_(pa.int64())), ("skipped_bytes", pa.int64()), ("checksums_wrong", pa.int64()), ("vbr_kind", pa.string()), ("tags", pa.list_(pa.string()))])

    def row(k, b):
        p = parse(b)
        return k, p["seconds"].numerator, p["seconds"].denominator, p["offsets"], p["skipped"], p["checksums_wrong"], (p["vbr"] or {}).get("kind"), sorted(p["tags"])

    return df.select(df[key].cast("long").alias("key"), df[data].alias("data")).mapInArrow(lambda it: batched(it, row, schema), "key long, seconds_num long, seconds_den long, frame_offsets array<long>, skipped_bytes long, checksums_wrong long, vbr_kind string, tags array<string>")


PAYLOAD = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def stored_texts(docs: DataFrame) -> DataFrame:
    """Each text (null: empty) as a padded payload in a stream, read back; see PAYLOAD."""
    kinds = {"long": pa.int64(), "string": pa.string()}
    schema = pa.schema([(n, kinds[k]) for n, k in (x.split() for x in PAYLOAD.split(", "))])

    def row(doc_id, text):
        raw = (text or "").encode("utf-8", "surrogatepass")
        media = wrap(raw + bytes(-len(raw) % 64 or (0 if raw else 64)))
        back = unwrap(media, parsed := parse(media))
        return doc_id, len(raw), len(back), sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), sha256(media).hexdigest(), feature(parsed)

    return docs.select("doc_id", "text").mapInArrow(lambda it: batched(it, row, schema), PAYLOAD)
