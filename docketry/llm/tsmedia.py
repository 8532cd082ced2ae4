"""Media columns: bytes stored as an MPEG transport stream, parsed back and described.

Writing: a program association table, a program map table and one private-data elementary stream, whose packetised (PES)
units of UNIT_BYTES carry presentation time stamps; each unit starts with a random-access point and a clock reference.
Reading: program tables are parsed (sections may span packets; their CRC is checked), the elementary stream's PID and type come
from them, continuity counters are checked (a packet sent twice is read once, a signalled discontinuity is no error), PES packets
are reassembled, and time stamps are kept with the random-access points.

The payload of a document is its UTF-8 text (null: empty) and zero bytes up to a positive multiple of 64.
Equal texts have equal streams. Any bytes can be read: what breaks off, is skipped or contradicts the format is counted as an
error and passed over.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import by_batch

# Fixed values of the transport-stream format.
PACKET, SYNC, PAT_PID, NULL_PID = 188, 0x47, 0x0000, 0x1FFF
PRIVATE_DATA_TYPE, PRIVATE_STREAM_ID = 0x06, 0xBD
#: This writer's choices.
PMT_PID, DATA_PID, PROGRAM, UNIT_BYTES, UNIT_TICKS = 0x0100, 0x0101, 1, 32_768, 3_600
#: Texts or streams that a task holds beside its batch, in bytes; a longer one is held alone.
SLICE_BYTES = 8_000_000


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1) ^ (0x04C11DB7 if c & 0x80000000 else 0)
        out.append(c & 0xFFFFFFFF)
    return out


_CRC = _crc_table()


def section_crc(raw: bytes) -> int:
    c = 0xFFFFFFFF
    for b in raw:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def _section(table: int, number: int, body: bytes) -> bytes:
    length = 5 + len(body) + 4
    raw = bytes([table, 0xB0 | length >> 8, length & 255, number >> 8, number & 255, 0xC1, 0, 0]) + body
    return raw + section_crc(raw).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    return (bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10, 0]) + section).ljust(PACKET, b"\xff")


def _tables() -> bytes:
    pat = _section(0x00, 1, bytes([PROGRAM >> 8, PROGRAM & 255, 0xE0 | PMT_PID >> 8, PMT_PID & 255]))
    pmt = _section(0x02, PROGRAM, bytes([0xE0 | DATA_PID >> 8, DATA_PID & 255, 0xF0, 0, PRIVATE_DATA_TYPE, 0xE0 | DATA_PID >> 8, DATA_PID & 255, 0xF0, 0]))
    return _table_packet(PAT_PID, pat) + _table_packet(PMT_PID, pmt)


_TABLES = _tables()


def _stamp(pts: int) -> bytes:
    return bytes([0x21 | (pts >> 29) & 0x0E, (pts >> 22) & 255, 1 | (pts >> 14) & 0xFE, (pts >> 7) & 255, 1 | (pts << 1) & 0xFE])


def _clock(pts: int) -> bytes:
    return (pts << 15 | 0x7E00).to_bytes(6, "big")


def write_stream(payload: bytes) -> bytes:
    """The payload as a transport stream."""
    parts, counter = [_TABLES], 0
    for k, at in enumerate(range(0, max(len(payload), 1), UNIT_BYTES)):
        unit, pts = payload[at : at + UNIT_BYTES], (k * UNIT_TICKS) & 0x1FFFFFFFF
        pes = b"\x00\x00\x01" + bytes([PRIVATE_STREAM_ID]) + (len(unit) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(pts) + unit
        # The first packet has an adaptation field of 8 bytes (random access, clock); the last one is stuffed.
        head, rest = pes[:176], pes[176:]
        pad = 176 - len(head)
        parts.append(bytes([SYNC, 0x40 | DATA_PID >> 8, DATA_PID & 255, 0x30 | counter & 15, 7 + pad, 0x50]) + _clock(pts) + b"\xff" * pad + head)
        counter += 1
        full = len(rest) // 184
        if full:
            body = np.empty((full, PACKET), dtype=np.uint8)
            body[:, :3] = (SYNC, DATA_PID >> 8, DATA_PID & 255)
            body[:, 3] = 0x10 | (counter + np.arange(full)) & 15
            body[:, 4:] = np.frombuffer(rest, dtype=np.uint8, count=full * 184).reshape(full, 184)
            parts.append(body.tobytes())
            counter += full
        if tail := rest[full * 184 :]:
            pad = 184 - len(tail)
            field_ = bytes([0]) if pad == 1 else bytes([pad - 1, 0]) + b"\xff" * (pad - 2)
            parts.append(bytes([SYNC, DATA_PID >> 8, DATA_PID & 255, 0x30 | counter & 15]) + field_ + tail)
            counter += 1
    return b"".join(parts)


@dataclass
class Stream:
    """What a transport stream holds: programs, the elementary stream's bytes, its time stamps and random-access points."""

    pmt_pid: int | None = None
    data_pid: int | None = None
    stream_type: int | None = None
    payload: bytes = b""
    units: int = 0
    packets: int = 0
    continuity_errors: int = 0
    sync_errors: int = 0
    table_errors: int = 0
    unit_errors: int = 0
    stamps: list[int] = field(default_factory=list)
    #: (packet index, time stamp) of each random-access point.
    access: list[tuple[int, int]] = field(default_factory=list)


def _body_at(packet: np.ndarray) -> int:
    """Where a packet's payload starts; PACKET if it has none."""
    if not packet[3] & 0x10:
        return PACKET
    return min(5 + int(packet[4]), PACKET) if packet[3] & 0x20 else 4


def _sections(rows: np.ndarray) -> Iterator[bytes]:
    """The raw sections that a PID's packets carry, whole or cut off."""
    raw = b""
    for packet in rows:
        body = packet[_body_at(packet) :].tobytes()
        if packet[1] & 0x40 and body:
            # What comes before the pointer's place ends the section that was open.
            if raw:
                yield raw + body[1 : 1 + body[0]]
            raw = body[1 + body[0] :]
        elif raw:
            raw += body
        while len(raw) >= 3 and raw[0] != 0xFF and len(raw) >= (size := 3 + ((raw[1] & 15) << 8 | raw[2])):
            yield raw[:size]
            raw = raw[size:]
        if raw[:1] == b"\xff":
            raw = b""
    if raw:
        yield raw


def _table(rows: np.ndarray, table: int, out: Stream) -> Iterator[bytes]:
    """Bodies of the sections of one table, between header and CRC; damaged ones are counted."""
    for raw in _sections(rows):
        if raw[0] != table:
            continue
        if len(raw) < 12 or len(raw) != 3 + ((raw[1] & 15) << 8 | raw[2]) or section_crc(raw) != 0:
            out.table_errors += 1
        else:
            yield raw[8:-4]


def _read_stamp(raw: bytes) -> int:
    return (raw[0] >> 1 & 7) << 30 | raw[1] << 22 | (raw[2] >> 1) << 15 | raw[3] << 7 | raw[4] >> 1


def _first_program(body: bytes) -> int | None:
    for k in range(0, len(body) - 3, 4):
        if body[k] << 8 | body[k + 1]:
            return (body[k + 2] & 31) << 8 | body[k + 3]
    return None


def _first_stream(body: bytes) -> tuple[int, int] | None:
    """(type, PID) of the first elementary stream of a program map."""
    at = 4 + ((body[2] & 15) << 8 | body[3]) if len(body) >= 4 else len(body)
    return (body[at], (body[at + 1] & 31) << 8 | body[at + 2]) if at + 5 <= len(body) else None


def read_stream(stored: bytes) -> Stream:
    """Parses a stored stream; damage is counted, not raised."""
    out = Stream()
    n = len(stored) // PACKET
    out.packets = n
    if not n:
        return out
    grid = np.frombuffer(stored, dtype=np.uint8, count=n * PACKET).reshape(n, PACKET)
    good = grid[:, 0] == SYNC
    out.sync_errors = int(n - good.sum())
    pid = (grid[:, 1].astype(np.int32) & 31) << 8 | grid[:, 2]
    out.pmt_pid = next((p for b in _table(grid[good & (pid == PAT_PID)], 0x00, out) if (p := _first_program(b)) is not None), None)
    if out.pmt_pid is None:
        return out
    found = next((x for b in _table(grid[good & (pid == out.pmt_pid)], 0x02, out) if (x := _first_stream(b)) is not None), None)
    if found is None:
        return out
    out.stream_type, out.data_pid = found
    mine = np.flatnonzero(good & (pid == out.data_pid) & ((grid[:, 3] & 0x10) > 0))
    rows = grid[mine]
    if not len(rows):
        return out
    # The counter goes up by one with each packet that carries data; the same packet may come twice in a row.
    ahead = np.diff((rows[:, 3] & 15).astype(np.int32)) % 16
    again = np.concatenate([[False], (ahead == 0) & (rows[1:, 4:] == rows[:-1, 4:]).all(axis=1)])
    adapted = (rows[:, 3] & 0x20) > 0
    signalled = adapted & (rows[:, 4] > 0) & ((rows[:, 5] & 0x80) > 0)
    kept = ~again
    rows, mine, adapted, signalled = rows[kept], mine[kept], adapted[kept], signalled[kept]
    ahead = np.diff((rows[:, 3] & 15).astype(np.int32)) % 16
    out.continuity_errors = int(((ahead != 1) & ~signalled[1:]).sum())
    skip = np.minimum(np.where(adapted, rows[:, 4].astype(np.int32) + 5, 4), PACKET)
    begins = np.flatnonzero((rows[:, 1] & 0x40) > 0)
    pieces = []
    for a, b in zip(begins, [*begins[1:], len(rows)]):
        first = rows[a, skip[a] :].tobytes()
        if first[:3] != b"\x00\x00\x01" or len(first) < 14:
            out.unit_errors += 1
            continue
        length, header = first[4] << 8 | first[5], 9 + first[8]
        stamp = _read_stamp(first[9:14]) if first[7] & 0x80 else None
        plain = a + 1
        while plain < b and not adapted[plain]:
            plain += 1
        body = b"".join([first, rows[a + 1 : plain, 4:].tobytes(), *(rows[k, skip[k] :].tobytes() for k in range(plain, b))])
        # A length of 0 means up to the next unit.
        out.unit_errors += int(len(body) < 6 + length)
        pieces.append(body[header : 6 + length if length else len(body)])
        out.units += 1
        if stamp is not None:
            out.stamps.append(stamp)
            if adapted[a] and rows[a, 4] > 0 and rows[a, 5] & 0x40:
                out.access.append((int(mine[a]), stamp))
    out.payload = b"".join(pieces)
    return out


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")


def describe(stream: Stream) -> str:
    """One line on a stream: program, type, units, packets, errors, time span and random-access points."""
    marks = zlib.crc32(b";".join(b"%d:%d" % m for m in stream.access))
    last = max(stream.stamps, default=0)
    return f"program={stream.pmt_pid};pid={stream.data_pid};type={stream.stream_type};units={stream.units};packets={stream.packets};continuity_errors={stream.continuity_errors};pts=0-{last};access_points={len(stream.access)};access_crc32={marks}"


def with_media(documents: DataFrame) -> DataFrame:
    """Each row's id, the payload's length, and its stored stream as a binary column `media`."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = [payload_of(t) for t in batch.column("text").to_pylist()]
        return pa.record_batch([batch.column("doc_id"), pa.array([n for n, _ in got], pa.int64()), pa.array([write_stream(p) for _, p in got], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return by_batch(documents.select("doc_id", "text"), work, "doc_id long, n_bytes long, media binary", rows=256, most_bytes=SLICE_BYTES)


def media_digest(media: DataFrame) -> DataFrame:
    """Reads the stored streams back: the digest columns and, for each stream, its random-access points."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for stored in batch.column("media").to_pylist():
            s = read_stream(stored)
            rows.append((len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), describe(s), [{"packet": p, "pts": t} for p, t in s.access]))
        cols = list(zip(*rows)) if rows else [()] * 7
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct([("packet", pa.int64()), ("pts", pa.int64())])))
        names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "access_points"]
        return pa.record_batch([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["doc_id", "n_bytes", *names])

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, access_points array<struct<packet:long,pts:long>>"
    return by_batch(media, work, schema, rows=256, most_bytes=SLICE_BYTES)
