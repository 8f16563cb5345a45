"""MPEG transport streams as a media column: writing, checking and reading back.

A payload is stored as the private elementary stream of a one-program transport
stream of 188-byte packets: a program association table, a program map table, then
one packetised elementary packet for each access unit, with a presentation time,
and with clock reference and random-access flag in its first transport packet.
``demux`` trusts nothing: it resynchronises on the sync byte, reassembles the sections
of the association table and the map tables over as many packets as they take
(checking their CRCs), and follows them to the elementary streams, each of which is
kept apart. A packet that repeats its predecessor is dropped, as the format allows
one; any other step of the continuity counter is a loss, unless the packet announces a
discontinuity. What follows a loss in an elementary packet is left out up to the next
one and the unit is named as damaged, so that no byte of a payload stands in a wrong
place unmarked. Presentation and decoding times are stored for each unit, with the byte
offset of each random-access point.

Edge cases: a null or empty text has a payload of spaces; equal texts give equal
streams; a damaged stream is read as far as it goes, faults are counted; repeated
rows are independent; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import map_batches, table

PACKET, SYNC = 188, 0x47
PAT_PID, PMT_PID, ES_PID, NULL_PID = 0x0000, 0x1000, 0x0100, 0x1FFF
#: Private data: stream id and stream type.
STREAM_ID, STREAM_TYPE = 0xBD, 0x06
PAD = 192
#: Payload bytes of an access unit, and ticks of 90 kHz from one to the next.
UNIT_BYTES, UNIT_TICKS = 64 * PAD, 3600
#: Every so many access units one is a random-access point.
KEY_INTERVAL = 4


def crc_table() -> list[int]:
    out = []
    for byte in range(256):
        crc = byte << 24
        for _ in range(8):
            crc = (crc << 1) ^ (0x04C11DB7 if crc & 0x80000000 else 0)
        out.append(crc & 0xFFFFFFFF)
    return out


_CRC = crc_table()


def section_crc(data: bytes) -> int:
    """The CRC-32 of program tables: most significant bit first, no final inversion. Zero over a section with its CRC."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc = ((crc << 8) & 0xFFFFFFFF) ^ _CRC[(crc >> 24) ^ byte]
    return crc


def section(table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | (len(body) + 9)).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + section_crc(head + body).to_bytes(4, "big")


def table_packet(pid: int, data: bytes) -> bytes:
    return (bytes([SYNC]) + (0x4000 | pid).to_bytes(2, "big") + b"\x10\x00" + data).ljust(PACKET, b"\xff")


_TABLES = table_packet(PAT_PID, section(0x00, 1, (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))) + table_packet(
    PMT_PID, section(0x02, 1, (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00")
)


def _stamp(ticks: int) -> bytes:
    """A 33-bit presentation time in its five bytes with marker bits."""
    t = ticks & 0x1FFFFFFFF
    return bytes([0x21 | t >> 29 & 0x0E, t >> 22 & 0xFF, 0x01 | t >> 14 & 0xFE, t >> 7 & 0xFF, 0x01 | t << 1 & 0xFE])


def _ticks(b: bytes) -> int:
    return (b[0] & 0x0E) << 29 | b[1] << 22 | (b[2] & 0xFE) << 14 | b[3] << 7 | b[4] >> 1


def mux(payload: bytes) -> bytes:
    """The transport stream of a payload."""
    out, counter = [_TABLES], 0
    for unit, at in enumerate(range(0, len(payload), UNIT_BYTES)):
        data, ticks = payload[at : at + UNIT_BYTES], unit * UNIT_TICKS
        pes = b"\x00\x00\x01" + bytes([STREAM_ID]) + (len(data) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(ticks) + data
        # the first packet's adaptation field: length, flags, clock reference, stuffing if the unit is short
        clock = (ticks & 0x1FFFFFFFF) << 15 | 0x7E00
        field_ = bytes([0x50 if unit % KEY_INTERVAL == 0 else 0x10]) + clock.to_bytes(6, "big")
        first = min(len(pes), PACKET - 4 - 1 - len(field_))
        field_ = field_.ljust(PACKET - 5 - first, b"\xff")
        out.append(bytes([SYNC]) + (0x4000 | ES_PID).to_bytes(2, "big") + bytes([0x30 | counter]) + bytes([len(field_)]) + field_ + pes[:first])
        counter = counter + 1 & 15
        body = (len(pes) - first) // (PACKET - 4)
        if body:
            packets = np.empty((body, PACKET), np.uint8)
            packets[:, 0], packets[:, 1], packets[:, 2] = SYNC, ES_PID >> 8, ES_PID & 255
            packets[:, 3] = 0x10 | (counter + np.arange(body)) & 15
            packets[:, 4:] = np.frombuffer(pes, np.uint8, body * (PACKET - 4), first).reshape(body, -1)
            out.append(packets.tobytes())
            counter = counter + body & 15
        rest = pes[first + body * (PACKET - 4) :]
        if rest:
            fill = PACKET - 5 - len(rest)  # a field of length 0 stands for one byte of stuffing
            stuffing = b"\x00".ljust(fill, b"\xff") if fill else b""
            out.append(bytes([SYNC]) + ES_PID.to_bytes(2, "big") + bytes([0x30 | counter, fill]) + stuffing + rest)
            counter = counter + 1 & 15
    return b"".join(out)


@dataclass
class Elementary:
    """One elementary stream."""

    kind: int
    payload: bytes = b""
    lost: int = 0  # continuity faults
    duplicates: int = 0
    damaged: list[int] = field(default_factory=list)  # units that lack bytes, by number
    times: list[int] = field(default_factory=list)  # presentation time of each unit in 90 kHz ticks, -1 without one
    decoding: list[int] = field(default_factory=list)  # decoding time, the presentation time where there is none
    random_access: list[tuple[int, int]] = field(default_factory=list)  # (ticks, byte offset of the transport packet)


@dataclass
class Stream:
    """What a transport stream holds."""

    packets: int = 0
    programs: dict[int, int] = field(default_factory=dict)
    streams: dict[int, Elementary] = field(default_factory=dict)
    bad_tables: int = 0
    bad_units: int = 0
    skipped: int = 0  # bytes out of sync

    def _all(self, of: str) -> list:
        return [x for _, e in sorted(self.streams.items()) for x in getattr(e, of)]

    @property
    def payload(self) -> bytes:
        """The streams' payloads one after the other, by their ids."""
        return b"".join(e.payload for _, e in sorted(self.streams.items()))

    @property
    def times(self) -> list[int]:
        return self._all("times")

    @property
    def random_access(self) -> list[tuple[int, int]]:
        return self._all("random_access")

    @property
    def lost(self) -> int:
        return sum(e.lost for e in self.streams.values())


def _synced(data: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """Whole packets that begin with the sync byte, their offsets, and the bytes left out."""
    whole = np.frombuffer(data, np.uint8, len(data) // PACKET * PACKET).reshape(-1, PACKET)
    if (whole[:, 0] == SYNC).all():
        return whole, np.arange(len(whole)) * PACKET, len(data) % PACKET
    starts, at = [], data.find(SYNC)
    while 0 <= at <= len(data) - PACKET:
        after = at + PACKET
        if after >= len(data) or data[after] == SYNC:
            starts.append(at)
            at = after
        else:
            at = data.find(SYNC, at + 1)
    raw = np.frombuffer(data, np.uint8)
    rows = raw[np.asarray(starts, int)[:, None] + np.arange(PACKET)] if starts else np.empty((0, PACKET), np.uint8)
    return rows, np.asarray(starts, int), len(data) - PACKET * len(starts)


def _sections(packets: list[tuple[bytes, bool, bool]]) -> Iterator[bytes | None]:
    """The sections that a table's packets (payload, whether one starts in it, whether packets are missing before it) make up; None for each unsound one."""
    held: bytes | None = None  # a section that has begun

    def ended(data: bytes) -> tuple[bytes | None, bytes] | None:
        """The section that data begins with, None if unsound, and what follows it; None if it isn't whole yet."""
        if len(data) < 3:
            return None
        size = 3 + (int.from_bytes(data[1:3], "big") & 0x0FFF)
        if len(data) < size:
            return None
        return (data[:size] if size >= 12 and section_crc(data[:size]) == 0 else None), data[size:]

    for data, starts, gap in packets:
        if gap and held is not None:
            yield None
            held = None
        if starts:
            pointer, data = data[0], data[1:]
            if held is not None:
                whole = ended(held + data[:pointer])
                yield whole[0] if whole else None
            held = data[pointer:]
        elif held is not None:
            held += data
        while held and held[0] != 0xFF and (whole := ended(held)):
            yield whole[0]
            held = whole[1]
        if held is not None and held[:1] in (b"", b"\xff"):  # stuffing up to the packet's end
            held = None
    if held is not None:
        yield None


def demux(data: bytes) -> Stream:
    rows, offsets, skipped = _synced(data)
    out = Stream(packets=len(rows), skipped=skipped)
    if not len(rows):
        return out
    pid = (rows[:, 1].astype(np.int32) & 0x1F) << 8 | rows[:, 2]
    starts_unit, has_field, has_data, counter = rows[:, 1] & 0x40 != 0, rows[:, 3] & 0x20 != 0, rows[:, 3] & 0x10 != 0, rows[:, 3].astype(np.int32) & 15
    begin = np.where(has_field, 5 + rows[:, 4].astype(np.int32), 4)
    flags = np.where(has_field & (rows[:, 4] > 0), rows[:, 5], 0)
    has_data &= begin < PACKET

    def followed(number: int) -> tuple[np.ndarray, np.ndarray, int]:
        """The packets of an id without repeated ones, before which of them packets are missing, and how many were repeated."""
        own = np.flatnonzero((pid == number) & has_data)
        step = np.diff(counter[own], prepend=counter[own[:1]] - 1) & 15
        step[:1] = 1
        again = [i for i in np.flatnonzero(step == 0).tolist() if rows[own[i], begin[own[i]] :].tobytes() == rows[own[i - 1], begin[own[i - 1]] :].tobytes()]
        repeated = sorted(set(again) - {i + 1 for i in again})  # one repetition is allowed
        keep = np.ones(len(own), bool)
        keep[repeated] = False
        own = own[keep]
        gap = np.diff(counter[own], prepend=counter[own[:1]] - 1) & 15 != 1
        gap &= flags[own] & 0x80 == 0  # an announced discontinuity
        gap[:1] = False
        return own, gap, len(repeated)

    def tables(number: int, table_id: int) -> Iterator[bytes]:
        own, gap, _ = followed(number)
        for body in _sections([(rows[i, begin[i] :].tobytes(), bool(starts_unit[i]), bool(g)) for i, g in zip(own, gap, strict=True)]):
            if body is None:
                out.bad_tables += 1
            elif body[0] == table_id:
                yield body

    for body in tables(PAT_PID, 0x00):
        for at in range(8, len(body) - 4, 4):
            if number := int.from_bytes(body[at : at + 2], "big"):
                out.programs[number] = int.from_bytes(body[at + 2 : at + 4], "big") & 0x1FFF
    for number in sorted(set(out.programs.values())):
        for body in tables(number, 0x02):
            at = 12 + (int.from_bytes(body[10:12], "big") & 0x0FFF)
            while at + 5 <= len(body) - 4:
                out.streams[int.from_bytes(body[at + 1 : at + 3], "big") & 0x1FFF] = Elementary(body[at])
                at += 5 + (int.from_bytes(body[at + 3 : at + 5], "big") & 0x0FFF)

    for number, stream in sorted(out.streams.items()):
        own, gap, stream.duplicates = followed(number)
        stream.lost = int(gap.sum())
        units = np.flatnonzero(starts_unit[own]).tolist()
        out.bad_units += bool(len(own)) and (not units or units[0] > 0)  # begins within a unit
        chunks = []
        for first, after in zip(units, [*units[1:], len(own)], strict=False):
            holes = np.flatnonzero(gap[first + 1 : after])
            members = own[first : first + 1 + holes[0]] if len(holes) else own[first:after]
            head = int(members[0])
            plain = begin[members] == 4
            if plain[1:-1].all():
                middle = rows[members[1:-1], 4:].tobytes()
                pes = rows[head, begin[head] :].tobytes() + middle + (rows[members[-1], begin[members[-1]] :].tobytes() if len(members) > 1 else b"")
            else:
                pes = b"".join(rows[m, begin[m] :].tobytes() for m in members)
            if pes[:3] != b"\x00\x00\x01" or len(pes) < 9 or len(pes) < 9 + pes[8]:
                out.bad_units += 1
                continue
            size, skip = int.from_bytes(pes[4:6], "big"), 9 + pes[8]
            if len(holes) or (len(pes) < 6 + size if size else after < len(own) and gap[after]):
                stream.damaged.append(len(stream.times))
            ticks = _ticks(pes[9:14]) if pes[7] & 0x80 and pes[8] >= 5 else -1
            stream.times.append(ticks)
            stream.decoding.append(_ticks(pes[14:19]) if pes[7] & 0xC0 == 0xC0 and pes[8] >= 10 else ticks)
            if flags[head] & 0x40:
                stream.random_access.append((ticks, int(offsets[head])))
            chunks.append(pes[skip : 6 + size] if size else pes[skip:])
        stream.payload = b"".join(chunks)
    return out


def padded(text: str | None) -> tuple[int, bytes]:
    """The text's UTF-8 length, and its bytes filled up with spaces to a positive multiple of PAD."""
    raw = (text or "").encode()
    return len(raw), raw.ljust(max(PAD, -(-len(raw) // PAD) * PAD), b" ")


def feature(s: Stream) -> str:
    kinds = ",".join(f"{pid}:{e.kind}" for pid, e in sorted(s.streams.items()))
    damaged = sum(len(e.damaged) for e in s.streams.values())
    points = ",".join(f"{t}@{o}" for t, o in s.random_access)
    return f"packets={s.packets};streams={kinds};units={len(s.times)};last_time={s.times[-1] if s.times else -1};random_access={points};lost={s.lost};bad={s.bad_tables + s.bad_units + damaged + s.skipped}"


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media binary): the texts' transport streams."""

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            made = [padded(t) for t in batch.column("text").to_pylist()]
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array([n for n, _ in made], pa.int64()), pa.array([mux(p) for _, p in made], pa.binary())], ["doc_id", "n_bytes", "media"]
            )

        return work

    return map_batches(docs.select("doc_id", "text"), make, "doc_id long, n_bytes long, media binary")


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def read_back(media: DataFrame) -> DataFrame:
    """Demultiplexes every stream of a media column and describes what it holds."""

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for doc_id, n_bytes, data in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media")), strict=True):
                s = demux(data or b"")
                p = s.payload
                rows.append((doc_id, n_bytes, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(data or b""), hashlib.sha256(data or b"").hexdigest(), feature(s)))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        return work

    return map_batches(media.select("doc_id", "n_bytes", "media"), make, DIGEST, "media")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(store(table(spark, sf_dir, "documents")))
