"""Media columns: MPEG transport streams (ISO/IEC 13818-1).

``store`` writes a payload as one program with one private elementary stream: program tables
before every random access point, one packetised unit for each ``UNIT`` bytes with a 90 kHz
timestamp, a clock reference and the random-access flag on every ``RAP_EVERY``-th unit.
``read_stream`` takes any transport stream: it follows the program tables, checks section
checksums and continuity counters, drops repeated packets, reassembles the packetised units of
every stream and keeps timestamps and random-access points. A packet starts at a sync byte that recurs one and two
packets on (as far as there is more); a unit that lost a packet, or is shorter than it says, is counted and not handed out.

Null texts count as empty (192 spaces are stored); repeated rows give equal rows; other columns are not read; an empty
table gives an empty one; a very long text is one stream, held once as text and once as packets.
"""

from __future__ import annotations

import functools
import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, table, type_of

PACKET, SYNC, STUFF = 188, 0x47, 0xFF
PMT_PID, STREAM_PID, PROGRAM, PRIVATE_DATA, PRIVATE_STREAM = 0x1000, 0x0100, 1, 0x06, 0xBD
FRAME, UNIT, RAP_EVERY, TICKS = 192, 3072, 8, 3600


@functools.cache
def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


def crc32_mpeg(data: bytes) -> int:
    c, t = 0xFFFFFFFF, _crc_table()
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ t[c >> 24 ^ b]
    return c


def _section(table_id: int, ident: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table_id, 0xB000 | len(body) + 9, ident, 0xC1, 0, 0) + body
    return head + struct.pack(">I", crc32_mpeg(head))


@functools.cache
def _tables() -> tuple[bytes, bytes]:
    """Packets of the two tables, their continuity counters at 0."""
    pat = _section(0, 1, struct.pack(">HH", PROGRAM, 0xE000 | PMT_PID))
    pmt = _section(2, PROGRAM, struct.pack(">HHBHH", 0xE000 | STREAM_PID, 0xF000, PRIVATE_DATA, 0xE000 | STREAM_PID, 0xF000))
    out = [struct.pack(">BHB", SYNC, 0x4000 | pid, 0x10) + b"\0" + s for pid, s in ((0, pat), (PMT_PID, pmt))]
    return tuple(x.ljust(PACKET, bytes([STUFF])) for x in out)


def _stamp(ticks: int) -> bytes:
    t = ticks % (1 << 33)
    return struct.pack(">BHH", 0x21 | t >> 29 & 0x0E, t >> 14 & 0xFFFE | 1, t << 1 & 0xFFFE | 1)


def pad(text: bytes) -> bytes:
    return text.ljust(max(1, -(-len(text) // FRAME)) * FRAME, b" ")


def write_stream(payload: bytes) -> bytes:
    out, cc, table_cc = [], 0, 0
    first = struct.pack(">BH", SYNC, 0x4000 | STREAM_PID)
    rest = struct.pack(">BH", SYNC, STREAM_PID)
    for unit, at in enumerate(range(0, len(payload), UNIT)):
        ticks, rap = unit * TICKS, unit % RAP_EVERY == 0
        data = payload[at : at + UNIT]
        body = struct.pack(">IHBBB", 0x100 | PRIVATE_STREAM, len(data) + 8, 0x84, 0x80, 5) + _stamp(ticks) + data
        field = b""
        if rap:
            out += [p[:3] + bytes([0x10 | table_cc]) + p[4:] for p in _tables()]
            table_cc = table_cc + 1 & 15
            base = ticks % (1 << 33)
            field = bytes([0x50]) + struct.pack(">IH", base >> 1, (base & 1) << 15 | 0x7E00)
        head, pos = first, 0
        while pos < len(body):
            room = 184 - (len(field) + 1 if field else 0)
            part = body[pos : pos + room]
            if len(part) < room or field:  # an adaptation field, stuffed if the unit ends here
                n = 184 - len(part) - 1
                fill = (field or (b"\0" if n else b"")).ljust(n, bytes([STUFF]))
                out.append(head + bytes([0x30 | cc, n]) + fill + part)
            else:
                out.append(head + bytes([0x10 | cc]) + part)
            pos, cc, field, head = pos + len(part), cc + 1 & 15, b"", rest
    return b"".join(out)


def _stamp_at(data: bytes, at: int) -> int:
    a, b, c = struct.unpack_from(">BHH", data, at)
    return (a & 0x0E) << 29 | (b & 0xFFFE) << 14 | c >> 1


class _Sections:
    """Puts sections of one PID together."""

    def __init__(self) -> None:
        self.buffer: bytearray | None = None

    def take(self, data: bytes, start: bool) -> list[bytes]:
        if start:
            skip = data[0] if data else 0
            done = self._cut(data[1 : 1 + skip]) if self.buffer is not None else []
            self.buffer = bytearray()
            return done + self._cut(data[1 + skip :])
        return self._cut(data) if self.buffer is not None else []

    def _cut(self, data: bytes) -> list[bytes]:
        self.buffer += data
        done = []
        while len(self.buffer) >= 3 and self.buffer[0] != STUFF:
            n = 3 + ((self.buffer[1] & 0x0F) << 8 | self.buffer[2])
            if len(self.buffer) < n:
                break
            done.append(bytes(self.buffer[:n]))
            del self.buffer[:n]
        return done


def read_stream(media: bytes) -> dict:
    """programs: program -> PMT PID; streams: PID -> type; units: (pid, pts, dts, random access, clock, bytes) of whole units; counts of faults."""
    out = {"programs": {}, "streams": {}, "units": [], "cc_errors": 0, "crc_errors": 0, "sync_losses": 0, "repeats": 0, "short_units": 0}
    sections: dict[int, _Sections] = {0: _Sections()}
    last: dict[int, tuple[int, int]] = {}  # counter and place of the last packet with payload
    open_units: dict[int, list] = {}

    def close(pid: int) -> None:
        rap, pcr, parts, whole = open_units.pop(pid)
        data = b"".join(parts)
        if len(data) < 9 or data[:3] != b"\0\0\1":
            out["short_units"] += 1
            return
        size, flags, head = data[4] << 8 | data[5], data[7] >> 6, 9 + data[8]
        body = data[head : 6 + size] if size else data[head:]
        if not whole or size and len(data) < 6 + size:
            out["short_units"] += 1
            return
        pts = _stamp_at(data, 9) if flags & 2 and head >= 14 else None
        dts = _stamp_at(data, 14) if flags == 3 and head >= 19 else pts
        out["units"].append((pid, pts, dts, rap, pcr, body))

    def in_step(at: int) -> bool:
        return all(at + k >= n or media[at + k] == SYNC for k in (0, PACKET, 2 * PACKET))

    at, n, synced = 0, len(media), False
    while at + PACKET <= n:
        if media[at] != SYNC or not synced and not in_step(at):
            out["sync_losses"] += 1
            at = media.find(bytes([SYNC]), at + 1)
            while 0 <= at and not in_step(at):
                at = media.find(bytes([SYNC]), at + 1)
            if at < 0 or at + PACKET > n:
                break
        synced = True
        b1, b2, b3 = media[at + 1], media[at + 2], media[at + 3]
        pid, start, pos, rap, pcr, broken = (b1 & 0x1F) << 8 | b2, b1 & 0x40, at + 4, False, None, False
        if b3 & 0x20:
            size = media[pos]
            if size:
                flags = media[pos + 1]
                rap, broken = bool(flags & 0x40), bool(flags & 0x80)
                if flags & 0x10 and size >= 7:
                    hi, lo = struct.unpack_from(">IH", media, pos + 2)
                    pcr = (hi << 1 | lo >> 15) * 300 + (lo & 0x1FF)
            pos += 1 + size
        this, at = at, at + PACKET
        if b1 & 0x80 or not b3 & 0x10 or pid == 0x1FFF or b3 & 0xC0 or pos > at:
            continue
        cc, seen = b3 & 15, last.get(pid)
        if seen is not None and not broken:
            if cc == seen[0] and media[this:at] == media[seen[1] : seen[1] + PACKET]:
                out["repeats"] += 1
                continue
            if cc != (seen[0] + 1 & 15):
                out["cc_errors"] += 1
                if pid in open_units:
                    open_units[pid][3] = False
        last[pid] = (cc, this)
        if pid in out["streams"]:
            if start:
                if pid in open_units:
                    close(pid)
                open_units[pid] = [rap, pcr, [media[pos:at]], True]
            elif pid in open_units:
                open_units[pid][2].append(media[pos:at])
        elif pid in sections:
            for s in sections[pid].take(media[pos:at], bool(start)):
                if crc32_mpeg(s):
                    out["crc_errors"] += 1
                elif s[0] == 0:
                    for i in range(8, len(s) - 4, 4):
                        program, to = struct.unpack_from(">HH", s, i)
                        if program:
                            out["programs"][program] = to & 0x1FFF
                            sections.setdefault(to & 0x1FFF, _Sections())
                elif s[0] == 2:
                    i = 12 + ((s[10] & 0x0F) << 8 | s[11])
                    while i + 5 <= len(s) - 4:
                        kind, to, more = struct.unpack_from(">BHH", s, i)
                        out["streams"][to & 0x1FFF] = kind
                        i += 5 + (more & 0x0FFF)
    for pid in list(open_units):
        close(pid)
    return out


SCHEMA = "payload binary, n_units int, pts array<bigint>, random_access array<bigint>, programs int, streams int, cc_errors int, crc_errors int, sync_losses int, repeats int, short_units int"


def _writer(id_col: str):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                texts = [(x or "").encode() for x in batch.column("text").slice(at, 256).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(id_col).slice(at, 256), pa.array([len(x) for x in texts], pa.int64()), pa.array([write_stream(pad(x)) for x in texts], pa.binary())], [id_col, "n_bytes", "media"])

    return run


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media)."""
    return arrow_map(docs.select(id_col, F.col(text_col).alias("text")), _writer(id_col), f"{id_col} {type_of(docs, id_col)}, n_bytes bigint, media binary")


def _reader(names: list[str], types: list[pa.DataType]):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, rows = batch.slice(at, 256), []
                for media in part.column("media").to_pylist():
                    x = read_stream(media or b"")
                    u = x["units"]
                    offsets = [0]
                    for unit in u:
                        offsets.append(offsets[-1] + len(unit[5]))
                    rows.append((b"".join(unit[5] for unit in u), len(u), [unit[1] for unit in u], [o for o, unit in zip(offsets, u, strict=False) if unit[3]], len(x["programs"]), len(x["streams"]), *(x[k] for k in names[6:])))
                cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, *cols], [*part.schema.names, *names])

    return run


def load(stored: DataFrame) -> DataFrame:
    """Adds to stored rows what their bytes hold: payload, timestamps, byte offsets of random-access points, faults."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    types = [pa.binary(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), *[pa.int32()] * 7]
    have = ", ".join(f"{c} {t}" for c, t in stored.dtypes)
    return arrow_map(stored, _reader(names, types), f"{have}, {SCHEMA}")


def op1_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = load(store(table(spark, sf_dir, "documents")))
    feature = F.format_string("programs=%d streams=%d units=%d pts=%d..%d rap=%s cc_errors=%d crc_errors=%d sync_losses=%d", "programs", "streams", "n_units", F.array_min("pts"), F.array_max("pts"), F.concat_ws("/", F.col("random_access").cast("array<string>")), "cc_errors", "crc_errors", "sync_losses")
    return x.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.expr("substring(payload, -16, 16)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"), "n_units", "cc_errors",
    )
