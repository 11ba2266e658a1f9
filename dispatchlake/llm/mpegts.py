"""Media columns: MPEG transport streams.

``mux`` stores a payload as the elementary stream of one program: program tables, then PES packets with time stamps,
cut into 188-byte packets. ``demux`` reads a stream back: it follows the program tables to the elementary stream,
checks the continuity counters, reassembles the PES packets and lists their time stamps and random-access points.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

PACKET = 188
PAT_PID, PMT_PID, DATA_PID = 0, 0x100, 0x101
PRIVATE_STREAM = 0xBD
PRIVATE_DATA = 0x06  # stream type: PES packets with private data
PES_PAYLOAD = 4096
TICKS = 3600  # of 90 kHz between PES packets
KEY_EVERY = 8  # PES packets from one random-access point to the next
ALIGN = 64


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


_CRC = _crc_table()


def section_crc(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ _CRC[c >> 24 ^ b]
    return c


def _section(table: int, ident: int, body: bytes) -> bytes:
    head = bytes([table]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + ident.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + section_crc(head + body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    return (bytes([0x47, 0x40 | pid >> 8, pid & 0xFF, 0x10, 0]) + section).ljust(PACKET, b"\xff")


def _tables() -> bytes:
    pat = _section(0, 1, (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
    stream = bytes([PRIVATE_DATA]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00"
    pmt = _section(2, 1, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + stream)
    return _table_packet(PAT_PID, pat) + _table_packet(PMT_PID, pmt)


TABLES = _tables()
_HEADS = [bytes([0x47, DATA_PID >> 8, DATA_PID & 0xFF, 0x10 | cc]) for cc in range(16)]


def _stamp(pts: int) -> bytes:
    return bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 0xFF, 0x01 | pts >> 14 & 0xFE, pts >> 7 & 0xFF, 0x01 | pts << 1 & 0xFE])


def _clock(ticks: int) -> bytes:
    """Program clock reference: 33 bits of 90 kHz, 6 reserved ones, 9 of 27 MHz."""
    return ((ticks & (1 << 33) - 1) << 15 | 0x3F << 9).to_bytes(6, "big")


def mux(payload: bytes) -> bytes:
    """A transport stream whose one elementary stream is the payload.

    The first packet of each PES packet carries the clock; every KEY_EVERYth is a random-access point.
    """
    out, cc = [TABLES], 0
    for n, a in enumerate(range(0, len(payload), PES_PAYLOAD)):
        data = payload[a : a + PES_PAYLOAD]
        ticks = n * TICKS & (1 << 33) - 1
        pes = b"\x00\x00\x01" + bytes([PRIVATE_STREAM]) + (len(data) + 8).to_bytes(2, "big") + b"\x80\x80\x05" + _stamp(ticks) + data
        spare = max(0, PACKET - 12 - len(pes))  # of the first packet, whose adaptation field has 8 bytes at least
        out.append(bytes([0x47, 0x40 | DATA_PID >> 8, DATA_PID & 0xFF, 0x30 | cc, 7 + spare, 0x10 | 0x40 * (n % KEY_EVERY == 0)]) + _clock(ticks) + b"\xff" * spare)
        at = PACKET - 12 - spare
        out.append(pes[:at])
        cc = cc + 1 & 15
        while at < len(pes):
            spare = PACKET - 4 - (len(pes) - at)
            if spare <= 0:
                out.append(_HEADS[cc])
            else:  # stuffing goes into the adaptation field
                stuffing = b"\x00" if spare == 1 else bytes([spare - 1, 0]) + b"\xff" * (spare - 2)
                out.append(bytes([0x47, DATA_PID >> 8, DATA_PID & 0xFF, 0x30 | cc]) + stuffing)
            out.append(pes[at : at + PACKET - 4])
            at += PACKET - 4
            cc = cc + 1 & 15
    return b"".join(out)


@dataclass
class Stream:
    """What demux finds: the payload, one entry for each PES packet, and what was lost or odd."""

    payload: bytes = b""
    stamps: list[int] = field(default_factory=list)  # 90 kHz, -1 without one
    offsets: list[int] = field(default_factory=list)  # of each PES packet's data in the payload
    random_access: list[bool] = field(default_factory=list)
    clocks: int = 0  # program clock references
    gaps: int = 0  # places where packets are missing by their counters
    errors: int = 0  # bytes without sync, damaged packets and tables, PES packets that aren't as long as they say
    repeats: int = 0  # packets sent twice
    packets: int = 0


class _Sections:
    """Puts the sections of a table together from the packets of its PID."""

    def __init__(self) -> None:
        self.held: bytes | None = None

    def feed(self, body: bytes, start: bool) -> Iterator[bytes | None]:
        """Sections that are complete now; None for one that is damaged."""
        if start:
            skip = 1 + body[0] if body else 1
            if skip > len(body):
                self.held = None
                yield None
                return
            if self.held:
                self.held += body[1:skip]
                yield from self._take()
            self.held = body[skip:]
        elif self.held is None:
            return
        else:
            self.held += body
        yield from self._take()

    def _take(self) -> Iterator[bytes | None]:
        while self.held and len(self.held) >= 3 and self.held[0] != 0xFF:
            size = 3 + ((self.held[1] & 0x0F) << 8 | self.held[2])
            if len(self.held) < size:
                return
            section, self.held = self.held[:size], self.held[size:]
            yield section if size >= 12 and not section_crc(section) else None


def _first_program(pat: bytes) -> int | None:
    """PID of the first program's table; program 0 is the network's."""
    for k in range(8, len(pat) - 7, 4):
        if pat[k] or pat[k + 1]:
            return (pat[k + 2] & 0x1F) << 8 | pat[k + 3]
    return None


def _first_stream(pmt: bytes) -> int | None:
    k = 12 + ((pmt[10] & 0x0F) << 8 | pmt[11])
    return (pmt[k + 1] & 0x1F) << 8 | pmt[k + 2] if k + 9 <= len(pmt) else None


def demux(media: bytes) -> Stream:
    """Reads the first program's first elementary stream of a transport stream.

    Damaged input never raises: what can't be read is left out and counted. A packet is a repeat only if all its bytes
    are those of the one before; any other break of the counters is a gap, and a PES packet that has lost bytes without
    one shows by its length.
    """
    s = Stream()
    pmt_pid = data_pid = None
    tables: dict[int, _Sections] = {PAT_PID: _Sections()}
    before: dict[int, bytes] = {}
    parts: list[bytes] = []
    total, due, is_open = 0, None, False  # bytes so far, bytes the open PES packet still has to bring (None: unknown)
    a = 0
    while a < len(media):
        packet = media[a : a + PACKET]
        s.packets += 1
        if len(packet) < PACKET or packet[0] != 0x47:
            s.errors += 1
            a += 1  # to the next place where two packets could begin
            while (a := media.find(b"\x47", a)) >= 0 and a + PACKET < len(media) and media[a + PACKET] != 0x47:
                a += 1
            if a < 0:
                break
            continue
        a += PACKET
        pid, control, cc = (packet[1] & 0x1F) << 8 | packet[2], packet[3] >> 4 & 3, packet[3] & 15
        if pid != data_pid and pid not in tables:
            continue
        at, flags = 4, 0
        if control & 2:
            n = packet[4]
            flags = packet[5] if n else 0
            at = 5 + n
        if packet[1] & 0x80 or at > PACKET:
            s.errors += 1
            continue
        if pid == data_pid and flags & 0x10 and at >= 12:
            s.clocks += 1
        if not control & 1:
            continue
        if (last := before.get(pid)) is not None:
            if packet == last:
                s.repeats += 1
                continue
            if cc != last[3] + 1 & 15 and not flags & 0x80:
                s.gaps += 1
                if pid in tables:
                    tables[pid].held = None
        before[pid] = packet
        start, body = bool(packet[1] & 0x40), packet[at:]
        if pid in tables:
            for section in tables[pid].feed(body, start):
                if section is None:
                    s.errors += 1
                elif pid == PAT_PID and section[0] == 0 and pmt_pid is None:
                    if (pmt_pid := _first_program(section)) is not None:
                        tables[pmt_pid] = _Sections()
                elif pid == pmt_pid and section[0] == 2 and data_pid is None:
                    data_pid = _first_stream(section)
            continue
        if start:
            s.errors += bool(due)
            head = 9 + body[8] if len(body) > 8 else PACKET
            is_open = body[:3] == b"\x00\x00\x01" and head <= len(body)
            if not is_open:
                s.errors += 1
                due = None
                continue
            p = body[9:14]
            stamped = body[7] & 0x80 and head >= 14
            s.stamps.append((p[0] & 0x0E) << 29 | p[1] << 22 | (p[2] & 0xFE) << 14 | p[3] << 7 | p[4] >> 1 if stamped else -1)
            s.offsets.append(total)
            s.random_access.append(bool(flags & 0x40))
            size = body[4] << 8 | body[5]
            due = size + 6 - head if size else None
            body = body[head:]
        if is_open:
            if due is not None:
                if len(body) > due:
                    s.errors += 1
                    body = body[: max(0, due)]
                due -= len(body)
            parts.append(body)
            total += len(body)
    s.errors += bool(due)
    s.payload = b"".join(parts)
    return s


def _mux(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        for lo in range(0, len(ids), 256):
            n, media = [], []
            for t in texts.slice(lo, 256):
                data = (t.as_py() or "").encode()
                n.append(len(data))
                media.append(mux(data + bytes(-len(data) % ALIGN or (0 if data else ALIGN))))
            yield pa.RecordBatch.from_arrays([ids.slice(lo, 256), pa.array(n, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])


def texts_to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8 bytes (null: none), zero-padded to a positive multiple of 64, as a stream.

    Equal texts give equal streams, repeated rows one each, an empty table none. A text is held whole while it is
    muxed, some 3 bytes a byte. Only the two columns are read, so the names of others don't matter.
    """
    C.prepare(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_mux, "doc_id long, n_bytes long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """Reads stored streams back: payload digest, the stored form's size and digest, and, for each PES packet, its time
    stamp, the place of its data in the payload and whether it is a random-access point."""
    C.prepare(media.sparkSession)
    kind = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pts array<long>, pes_offset array<long>, random_access array<boolean>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows = []
                for m in part.column(2):
                    raw = m.as_py()
                    s = demux(raw)
                    feature = f"packets={s.packets};pes={len(s.stamps)};random_access={sum(s.random_access)};last_pts={max(s.stamps, default=-1)};clocks={s.clocks};gaps={s.gaps};repeats={s.repeats};errors={s.errors}"
                    rows.append((len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-ALIGN:]), len(raw), hashlib.sha256(raw).hexdigest(), feature, s.stamps, s.offsets, s.random_access))
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 9
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.bool_())]
                names = [x.split()[0] for x in kind.split(", ")]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *[pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)]], names=names)

    return media.mapInArrow(run, kind)
