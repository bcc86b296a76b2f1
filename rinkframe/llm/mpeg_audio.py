"""MPEG audio columns: payloads in layer III frames, and a reader that resynchronises.

A stored form is an ID3v2 tag (payload length), a Xing frame (variable-bitrate table) and mono 48 kHz
MPEG-1 layer III frames with checksums. Their side information is zero, so that a decoder plays
silence and the main data area carries the payload as ancillary bytes. The reader takes MPEG 1, 2 and 2.5 audio of layers I to III (but no free-format
bitrates): it looks for frame
headers (a valid checksum or a second header in a row makes a lock), parses ID3v2 tags and Xing, Info or VBRI tables, holds a table's frames, bytes and seek places
against the frames found, verifies every CRC-16 of layer III (those of the others cover data of varying length and aren't verified), and gives exact
durations and the byte offset of each frame, as columns.

Defined results: null is an empty text; a payload is padded with zeros to a positive multiple of 64;
equal texts have equal stored forms; repeated rows repeat; ids of any type are kept; extra columns are ignored; empty tables give no rows. Bytes without a frame
have no frames, 0 seconds and all bytes skipped; a cut tag or frame is skipped as well.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, steps, table

# kbit/s by bitrate index from 1, by (MPEG 1 or not, layer); sample rates of MPEG 1 by index.
BITRATES = {
    (True, 1): [32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448],
    (True, 2): [32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384],
    (True, 3): [32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320],
    (False, 1): [32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256],
    (False, 2): [8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
    (False, 3): [8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
}
RATES = [44_100, 48_000, 32_000]
#: Of the frames that store() writes: bitrates, sample rate, samples of a frame; head, CRC and side information in bytes.
KBITS = BITRATES[True, 3]
RATE, SAMPLES, HEAD, CRC, SIDE = 48_000, 1152, 4, 2, 17
ROOM = [3 * k - HEAD - CRC - SIDE for k in KBITS]


@functools.lru_cache(4096)
def crc16(data: bytes) -> int:
    """CRC-16 (polynomial 0x8005, start 0xFFFF) of the protected header half and side information."""
    crc = 0xFFFF
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


@functools.cache
def _front(index: int) -> bytes:
    """Header, checksum and empty side information of a frame with the bitrate of that index."""
    head = bytes([0xFF, 0xFA, (index + 1) << 4 | 1 << 2, 0xC0])
    return head + struct.pack(">H", crc16(head[2:] + bytes(SIDE))) + bytes(SIDE)


def pad64(data: bytes) -> bytes:
    return data + bytes(-len(data) % 64 or (0 if data else 64))


def seek_table(sizes: list[int]) -> bytes:
    """The Xing table: for each hundredth of the frames, the place of the frame in 256ths of the bytes. sizes: of the table's frame and of all others."""
    total, run, marks = sum(sizes), 0, []
    for s in sizes[:-1]:
        run += s
        marks.append(run)
    return bytes(min(255, 256 * marks[min(len(marks) - 1, p * len(marks) // 100)] // total) for p in range(100))


def store(payload: bytes) -> bytes:
    frames, at = [], 0
    while at < len(payload):
        left = len(payload) - at
        index = next((i for i, r in enumerate(ROOM) if r >= left), len(ROOM) - 1)
        frames.append(_front(index) + payload[at : at + ROOM[index]].ljust(ROOM[index], b"\0"))
        at += ROOM[index]
    sizes = [3 * KBITS[8], *map(len, frames)]
    xing = b"Xing" + struct.pack(">III", 7, len(frames), sum(sizes)) + seek_table(sizes)
    first = (_front(8) + xing).ljust(sizes[0], b"\0")
    body = b"TXXX" + struct.pack(">IH", 9 + 12, 0) + b"\0payload\0" + b"%012d" % len(payload)
    n = len(body)
    tag = b"ID3\x03\0\0" + bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127]) + body
    return tag + first + b"".join(frames)


class Frame(NamedTuple):
    size: int
    samples: int
    rate: int
    layer: int
    protected: bool
    side: int


@functools.lru_cache(1 << 12)
def _frame(head: bytes) -> Frame | None:
    if head[0] != 0xFF or head[1] & 0xE0 != 0xE0:
        return None
    version, layer, kbit, rate = head[1] >> 3 & 3, 4 - (head[1] >> 1 & 3), head[2] >> 4, head[2] >> 2 & 3
    if version == 1 or layer == 4 or not 0 < kbit < 15 or rate == 3:
        return None
    full = version == 3
    hertz = RATES[rate] // (1 if full else 2 if version == 2 else 4)
    samples = 384 if layer == 1 else 576 if layer == 3 and not full else 1152
    slots = samples // 8 * 1000 * BITRATES[full, layer][kbit - 1]
    padding = head[2] >> 1 & 1
    size = (slots // 4 // hertz + padding) * 4 if layer == 1 else slots // hertz + padding
    mono = head[3] >> 6 == 3
    side = 0 if layer != 3 else (17 if mono else 32) if full else (9 if mono else 17)
    return Frame(size, samples, hertz, layer, not head[1] & 1, side)


def frame(data: bytes, at: int) -> Frame | None:
    """The frame whose header is at this place, if one is."""
    return _frame(data[at : at + HEAD]) if at + HEAD <= len(data) else None


def tags(data: bytes) -> tuple[dict[str, str], int]:
    """Text frames of an ID3v2 tag at the start, and the bytes it takes (0 without a whole tag)."""
    if data[:3] != b"ID3" or len(data) < 10:
        return {}, 0
    size = lambda b: b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]
    end = 10 + size(data[6:10])
    if end > len(data):
        return {}, 0
    out, at = {}, 10
    while at + 10 < end and data[at : at + 4].strip(b"\0"):
        n = size(data[at + 4 : at + 8]) if data[3] >= 4 else struct.unpack(">I", data[at + 4 : at + 8])[0]
        body = data[at + 10 : min(end, at + 10 + n)]
        if data[at : at + 1] == b"T" and body:
            text = body[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be"}.get(body[0], "utf-8"), "replace")
            name, _, value = text.partition("\0") if data[at : at + 4] == b"TXXX" else ("", "", text)
            out[data[at : at + 4].decode("latin-1") + (f":{name}" if name else "")] = value.rstrip("\0")
        at += 10 + n
    return out, end


def table_of(data: bytes, at: int, f: Frame) -> tuple[int | None, int | None, bytes | None] | None:
    """(frames, bytes, seek table) of a Xing, Info or VBRI header in this frame, None without one."""
    x = at + HEAD + CRC * f.protected + f.side
    if data[x : x + 4] in (b"Xing", b"Info") and x + 120 <= at + f.size:
        flags, x, got = struct.unpack(">I", data[x + 4 : x + 8])[0], x + 8, []
        for bit in (1, 2):
            got.append(struct.unpack(">I", data[x : x + 4])[0] if flags & bit else None)
            x += 4 * bool(flags & bit)
        return got[0], got[1], data[x : x + 100] if flags & 4 else None
    if data[at + 36 : at + 40] == b"VBRI" and f.size >= 62:
        many, frames = struct.unpack(">II", data[at + 46 : at + 54])
        return frames, many, None
    return None


def load(data: bytes) -> dict:
    """payload (layer III), offsets (of audio frames), samples, seconds, rate, crc_errors, skipped (bytes passed to find headers), tags, vbr_frames, vbr_ok (null without a table)."""
    found, at = tags(data)
    end = len(data) - 128 if len(data) - 128 >= at and data[-128:-125] == b"TAG" else len(data)
    offsets, sizes, parts, errors, skipped, samples, seconds, rate = [], [], [], 0, 0, 0, 0.0, None
    declared, locked = None, False
    while at < end:
        f = frame(data, at)
        whole = f is not None and f.size >= HEAD and at + f.size <= end
        sound = whole and f.layer == 3 and f.protected and crc16(data[at + 2 : at + 4] + data[at + 6 : at + 6 + f.side]) == data[at + 4] << 8 | data[at + 5]
        if not whole or not (locked or sound or at + f.size == end or frame(data, at + f.size)):
            at, skipped, locked = at + 1, skipped + 1, False
            continue
        locked = True
        errors += bool(f.layer == 3 and f.protected and not sound)
        if not sizes and (declared := table_of(data, at, f)):
            sizes.append(f.size)
        else:
            offsets.append(at)
            sizes.append(f.size)
            parts.append(data[at + HEAD + CRC * f.protected + f.side : at + f.size])
            samples, seconds, rate = samples + f.samples, seconds + f.samples / f.rate, rate or f.rate
        at += f.size
    ok = None
    if declared:
        frames, many, places = declared
        ok = frames in (None, len(offsets)) and many in (None, sum(sizes)) and (places is None or not offsets or places == seek_table(sizes))
    payload, length = b"".join(parts), found.get("TXXX:payload", "")
    return {
        "payload": payload[: int(length)] if length.isdigit() else payload, "offsets": offsets, "samples": samples, "seconds": samples / rate if rate and abs(samples / rate - seconds) < 1e-6 * seconds else seconds, "rate": rate,
        "crc_errors": errors, "skipped": skipped, "tags": found, "vbr_frames": declared[0] if declared else None, "vbr_ok": ok,
    }


INFO = "samples long, seconds double, rate int, offsets array<long>, crc_errors long, skipped long, tags map<string,string>, vbr_frames long, vbr_ok boolean"


def media_columns(media: DataFrame, media_col: str = "media", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep`, and what load() tells of each stored form but its payload; null media is empty."""
    names = [x.split()[0] for x in INFO.split(", ")]
    kinds = [pa.int64(), pa.float64(), pa.int32(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.int64(), pa.bool_()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "__media"):
            rows = [load(x or b"") for x in batch.column("__media").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.drop_columns(["__media"]).columns, *(pa.array([list(r[c].items()) if c == "tags" else r[c] for r in rows], k) for c, k in zip(names, kinds, strict=True))], [*keep, *names])

    source = media.select(*keep, F.col(media_col).alias("__media"))
    return arrow_map(source, run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in media.select(*keep).schema), INFO]))


def audio(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_bytes, media (binary): the stored form of each whole text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            texts = [(x or "").encode() for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([len(x) for x in texts], pa.int64()), pa.array([store(pad64(x)) for x in texts], pa.binary())], [id_col, "n_bytes", "media"])

    df = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return arrow_map(df, run, f"`{id_col}` {df.schema['id'].dataType.simpleString()}, n_bytes long, media binary")


def op6_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "media"):
            rows = []
            for data in batch.column("media").to_pylist():
                x = load(data)
                p = x["payload"]
                seek = zlib.crc32(struct.pack(f">{len(x['offsets'])}Q", *x["offsets"]))
                rows.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(data), hashlib.sha256(data).hexdigest(), f"frames={len(x['offsets'])};samples={x['samples']};rate={x['rate']};crc_errors={x['crc_errors']};skipped={x['skipped']};vbr_ok={x['vbr_ok']};seek_crc32={seek}", x["seconds"], x["offsets"]))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "seconds", "seek_offsets"])

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, seconds double, seek_offsets array<long>"
    return arrow_map(audio(table(spark, sf_dir, "documents")), run, schema)
