"""Media columns: payloads as MPEG transport streams (ISO/IEC 13818-1).

Each payload is multiplexed as one program with one private elementary stream: program
tables, packetised elementary packets of UNITS samples blocks with a 90 kHz timestamp,
and random-access points with clock references. The stream is a binary column written to
the shared folder; reading it back parses the program tables (with their CRC), checks
every continuity counter, drops duplicated packets, reassembles the elementary packets
and lists timestamps and random-access points.

Rows are independent: no shuffle, memory of one row and one output batch at a time.

Defined results: null text is an empty payload (one block of padding); repeated rows give
repeated results and equal texts equal streams; null doc_id stays null; an empty table
gives no rows; extra columns are ignored. A damaged stream raises on a bad sync byte or
table CRC. Otherwise it counts continuity errors (a step of a counter, on the tables' and the
stream's packets alike, without a sign of discontinuity, or a repeated counter whose packet is
not a copy of the one before) and uneven units (elementary packets of fewer or more bytes
than they say, as when sixteen packets are lost, which counters do not show). What is left of
a short unit is never filled from the next one.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import map_arrow, materialise, table

BLOCK = 576
#: Blocks in one elementary packet: 64 x 576 bytes and the header stay below the 16-bit packet length.
UNITS = 64
PACKET = 188
SYNC, PAT_PID, PMT_PID, STREAM_PID = 0x47, 0x0000, 0x1000, 0x0100
STREAM_TYPE, STREAM_ID = 0x06, 0xBD
#: 90 kHz ticks of one block of 576 samples at 48 kHz.
TICKS = 1080
#: Program tables come again after so many elementary packets.
TABLES_EVERY = 16
OUTPUT_BYTES = 8 << 20


def pad(data: bytes) -> bytes:
    """``data`` with bytes 255 up to a positive multiple of BLOCK."""
    return data + b"\xff" * (-len(data) % BLOCK if data else BLOCK)


@lru_cache(maxsize=1024)
def crc_mpeg(section: bytes) -> int:
    """CRC-32/MPEG-2: polynomial 0x04C11DB7, most significant bit first, no final inversion."""
    crc = 0xFFFFFFFF
    for byte in section:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ (0x04C11DB7 if crc & 0x80000000 else 0)) & 0xFFFFFFFF
    return crc


def section(table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + crc_mpeg(head + body).to_bytes(4, "big")


@lru_cache(maxsize=1)
def tables() -> tuple[bytes, bytes]:
    pat = section(0x00, 1, (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
    pmt = section(0x02, 1, (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\x00")
    return pat, pmt


def table_packet(pid: int, sect: bytes, counter: int) -> bytes:
    return (bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10 | counter & 15, 0]) + sect).ljust(PACKET, b"\xff")


def timestamp(pts: int) -> bytes:
    return bytes([0x21 | pts >> 29 & 14, pts >> 22 & 255, pts >> 14 & 254 | 1, pts >> 7 & 255, pts << 1 & 254 | 1])


def read_timestamp(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | b[2] >> 1 << 15 | b[3] << 7 | b[4] >> 1


def elementary(data: bytes, pts: int, counter: int) -> np.ndarray:
    """Transport packets of one elementary packet that starts with a random-access point."""
    pes = np.frombuffer(b"\x00\x00\x01" + bytes([STREAM_ID]) + (len(data) + 8).to_bytes(2, "big") + b"\x80\x80\x05" + timestamp(pts) + data, np.uint8)
    first = PACKET - 4 - 8
    rest = -(-(len(pes) - first) // (PACKET - 4))
    out = np.full((rest + 1, PACKET), 255, np.uint8)
    out[:, 0], out[:, 1], out[:, 2] = SYNC, STREAM_PID >> 8, STREAM_PID & 255
    out[:, 3] = 0x10 | (counter + np.arange(rest + 1)) & 15
    out[0, 1] |= 0x40
    out[0, 3] |= 0x20
    clock = pts & (1 << 33) - 1
    out[0, 4:12] = np.frombuffer(b"\x07\x50" + (clock << 15 | 0x7E00).to_bytes(6, "big"), np.uint8)
    out[0, 12:] = pes[:first]
    body = pes[first:]
    full = len(body) // (PACKET - 4)
    out[1 : full + 1, 4:] = body[: full * (PACKET - 4)].reshape(full, PACKET - 4)
    if full < rest:
        left = body[full * (PACKET - 4) :]
        stuffing = PACKET - 5 - len(left)
        out[-1, 3] |= 0x20
        out[-1, 4] = stuffing
        if stuffing:
            out[-1, 5] = 0
        out[-1, PACKET - len(left) :] = left
    return out


def mux(payload: bytes) -> bytes:
    """One transport stream with ``payload`` as its elementary stream."""
    pat, pmt = tables()
    out, counter = [], 0
    for k, at in enumerate(range(0, len(payload), UNITS * BLOCK)):
        if k % TABLES_EVERY == 0:
            out += [table_packet(PAT_PID, pat, k // TABLES_EVERY), table_packet(PMT_PID, pmt, k // TABLES_EVERY)]
        packets = elementary(payload[at : at + UNITS * BLOCK], TICKS * UNITS * k, counter)
        counter += len(packets)
        out.append(packets.tobytes())
    return b"".join(out)


def sections(packets: np.ndarray) -> Iterator[bytes]:
    """Table sections that start in ``packets``, each of one packet; a CRC that does not fit raises."""
    for p in packets:
        if not p[1] & 0x40:
            continue
        at = 4 + (1 + int(p[4]) if p[3] & 0x20 else 0)
        at += 1 + int(p[at])
        end = at + 3 + ((int(p[at + 1]) & 15) << 8 | int(p[at + 2]))
        found = p[at:end].tobytes()
        if end > PACKET or crc_mpeg(found[:-4]) != int.from_bytes(found[-4:], "big"):
            raise ValueError("a program table's CRC does not fit")
        yield found


def continuity(own: np.ndarray) -> tuple[np.ndarray, int]:
    """(packets that are copies of the one before, breaks of the counter) of the packets of one PID.

    A copy has the same counter and the same bytes but for the clock reference.
    """
    if not len(own):
        return np.zeros(0, bool), 0
    step = np.diff((own[:, 3] & 15).astype(np.int16)) % 16
    unlike = own[1:] != own[:-1]
    clocked = (own[:, 3] & 0x20 != 0) & (own[:, 4] >= 7) & (own[:, 5] & 0x10 != 0)
    unlike[clocked[1:] & clocked[:-1], 6:12] = False
    again = (step == 0) & ~unlike.any(1)
    announced = (own[1:, 3] & 0x20 != 0) & (own[1:, 4] > 0) & (own[1:, 5] & 0x80 != 0)
    return np.concatenate([[False], again]), int(((step != 1) & ~again & ~announced).sum())


def unwrapped(pts: int, last: int) -> int:
    """A 33-bit timestamp as the number nearest to the one before it."""
    return pts + ((last - pts + (1 << 32)) >> 33 << 33) if last else pts


def demux(stream: bytes) -> dict:
    """payload, programs, streams, packets, continuity_errors, uneven_units, pts, random_access (packet numbers)."""
    packets = np.frombuffer(stream, np.uint8)
    if len(packets) % PACKET or (packets[::PACKET] != SYNC).any():
        raise ValueError("not a whole number of transport packets")
    packets = packets.reshape(-1, PACKET)
    pid = (packets[:, 1].astype(np.int32) & 31) << 8 | packets[:, 2]
    programs: dict[int, int] = {}
    for s in sections(packets[pid == PAT_PID]):
        programs |= {int.from_bytes(s[i : i + 2], "big"): int.from_bytes(s[i + 2 : i + 4], "big") & 0x1FFF for i in range(8, len(s) - 4, 4)}
    streams: dict[int, int] = {}
    for where in set(programs.values()):
        for s in sections(packets[pid == where]):
            i = 12 + (int.from_bytes(s[10:12], "big") & 0xFFF)
            while i < len(s) - 4:
                streams[int.from_bytes(s[i + 1 : i + 3], "big") & 0x1FFF] = s[i]
                i += 5 + (int.from_bytes(s[i + 3 : i + 5], "big") & 0xFFF)
    payload, pts, access, uneven = [], [], [], 0
    errors = sum(continuity(packets[pid == where])[1] for where in {PAT_PID, *programs.values()})
    for where in sorted(streams):
        numbers = np.flatnonzero((pid == where) & (packets[:, 3] & 0x10 != 0))
        own = packets[numbers]
        again, broken = continuity(own)
        errors += broken
        numbers, own = numbers[~again], own[~again]
        field = own[:, 3] & 0x20 != 0
        begin = np.where(field, 5 + own[:, 4].astype(np.int64), 4)
        access += numbers[field & (own[:, 4] > 0) & (own[:, 5] & 0x40 != 0)].tolist()
        joined = own[np.arange(PACKET) >= begin[:, None]].tobytes()
        ends = np.cumsum(PACKET - begin)
        starts = np.flatnonzero(own[:, 1] & 0x40)
        at = (ends[starts] - (PACKET - begin[starts])).tolist()
        for a, b in zip(at, [*at[1:], len(joined)], strict=True):
            if joined[a : a + 3] != b"\x00\x00\x01":
                raise ValueError("an elementary packet has no start code")
            head = a + 9 + joined[a + 8]
            if joined[a + 7] & 0x80:
                pts.append(unwrapped(read_timestamp(joined[a + 9 : a + 14]), pts[-1] if pts else 0))
            length = int.from_bytes(joined[a + 4 : a + 6], "big")
            uneven += bool(length) and a + 6 + length != b
            payload.append(joined[head : min(a + 6 + length, b) if length else b])
    return {"payload": b"".join(payload), "programs": programs, "streams": streams, "packets": len(packets), "continuity_errors": errors, "uneven_units": uneven, "pts": pts, "random_access": access}


def batches(rows: Iterator[tuple], schema: pa.Schema, weigh) -> Iterator[pa.RecordBatch]:
    """Record batches of about OUTPUT_BYTES."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += weigh(row)
        if size >= OUTPUT_BYTES:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


STORED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
DIGEST = pa.schema([
    ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()),
    ("media_sha256", pa.string()), ("feature", pa.string()), ("pts", pa.list_(pa.int64())), ("random_access", pa.list_(pa.int64())), ("continuity_errors", pa.int64()),
])


def encode(documents: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): the padded text of each row as a transport stream."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for part in parts:
                texts = part.column(1).cast(pa.large_binary())
                for doc_id, text in zip(part.column(0), texts, strict=True):
                    data = text.as_py() or b""
                    yield doc_id.as_py(), len(data), mux(pad(data))

        yield from batches(rows(), STORED, lambda r: len(r[2]))

    return map_arrow(documents.select("doc_id", "text"), run, "doc_id long, n_bytes long, media binary")


def decode(stored: DataFrame) -> DataFrame:
    """Features of stored streams, with the payload's and the stream's digests, timestamps and random-access points."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for part in parts:
                for doc_id, n, media in zip(part.column(0), part.column(1), part.column(2), strict=True):
                    stream = media.as_py()
                    d = demux(stream)
                    p = d["payload"]
                    mean = int(np.frombuffer(p, np.uint8).sum(dtype=np.int64)) // len(p)
                    feature = f"programs={len(d['programs'])};streams={','.join(f'{k:x}:{v:x}' for k, v in sorted(d['streams'].items()))};packets={d['packets']};units={len(d['pts'])};access={len(d['random_access'])};errors={d['continuity_errors'] + d['uneven_units']};last_pts={d['pts'][-1]};mean={mean}"
                    yield doc_id.as_py(), n.as_py(), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(stream), hashlib.sha256(stream).hexdigest(), feature, d["pts"], d["random_access"], d["continuity_errors"] + d["uneven_units"]

        yield from batches(rows(), DIGEST, lambda r: 400 + 16 * len(r[8]))

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pts array<long>, random_access array<long>, continuity_errors long"
    return map_arrow(stored.select("doc_id", "n_bytes", "media"), run, schema)


def op6_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = materialise(encode(table(spark, sf_dir, "documents")), "media")
    return decode(stored).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
