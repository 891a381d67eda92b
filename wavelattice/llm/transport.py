"""Media columns as MPEG transport streams: packets written and taken apart with whole-array operations.

A payload is cut into frames of 576 bytes (24 ms of 48 kHz, 192 kbit/s); eight frames make an elementary-stream packet
with a timestamp; each such packet begins in a transport packet that is a random-access point and carries the clock.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import byte_slices, lengths_of

FRAME_BYTES = 576
FRAME_TICKS = 2160  # of 90 kHz
FRAMES_A_PACKET = 8
TABLES_EVERY = 64  # elementary packets between two copies of the program tables
PMT_PID, MEDIA_PID, PROGRAM = 0x100, 0x101, 1
FIRST_PTS = 90_000
CLOCK_LEAD = 9_000
HEADER = 14  # of an elementary packet: start code, length, flags, one timestamp
BATCH_BYTES = 16 << 20  # of values that are worked on at a time (a larger one on its own)
ADAPTATION = 8  # length, flags and clock of a random-access point


@lru_cache(maxsize=1)
def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


def section_crc(data: bytes) -> int:
    """CRC-32 of program tables (most significant bit first); 0 over a section that ends in its own CRC."""
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _crc_table()[(c >> 24) ^ b]
    return c


def _section(table_id: int, ident: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | (len(body) + 9)).to_bytes(2, "big") + ident.to_bytes(2, "big") + b"\xc1\0\0"
    return head + body + section_crc(head + body).to_bytes(4, "big")


@lru_cache(maxsize=1)
def _table_packets() -> np.ndarray:
    """The two program tables, a transport packet each, with counters of 0."""
    association = _section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
    program = _section(2, PROGRAM, (0xE000 | MEDIA_PID).to_bytes(2, "big") + b"\xf0\0" + b"\x06" + (0xE000 | MEDIA_PID).to_bytes(2, "big") + b"\xf0\0")
    out = np.full((2, 188), 0xFF, np.uint8)
    for row, pid, section in ((0, 0, association), (1, PMT_PID, program)):
        packet = b"\x47" + (0x4000 | pid).to_bytes(2, "big") + b"\x10\0" + section
        out[row, : len(packet)] = np.frombuffer(packet, np.uint8)
    return out


def _stamp(ticks: np.ndarray) -> np.ndarray:
    """The five bytes of a 33-bit timestamp with its marker bits."""
    return np.stack([0x21 | (ticks >> 29 & 0x0E), ticks >> 22 & 0xFF, 0x01 | (ticks >> 14 & 0xFE), ticks >> 7 & 0xFF, 0x01 | (ticks << 1 & 0xFE)], axis=-1).astype(np.uint8)


def _clock(ticks: np.ndarray) -> np.ndarray:
    return np.stack([ticks >> 25 & 0xFF, ticks >> 17 & 0xFF, ticks >> 9 & 0xFF, ticks >> 1 & 0xFF, (ticks & 1) << 7 | 0x7E, ticks * 0], axis=-1).astype(np.uint8)


def _elementary(data: np.ndarray, pts: np.ndarray, counter: int) -> np.ndarray:
    """Transport packets of equally long elementary packets, one a row of ``data``."""
    n, size = data.shape
    whole = np.empty((n, HEADER + size), np.uint8)
    whole[:, :9] = np.frombuffer(b"\0\0\x01\xbd" + (size + HEADER - 6).to_bytes(2, "big") + b"\x84\x80\x05", np.uint8)
    whole[:, 9:14] = _stamp(pts)
    whole[:, 14:] = data
    lead = 184 - ADAPTATION
    rest = whole.shape[1] - lead
    k = 1 + -(-rest // 184)
    out = np.empty((n, k, 188), np.uint8)
    out[:, :, 0] = 0x47
    out[:, :, 1] = MEDIA_PID >> 8
    out[:, 0, 1] |= 0x40
    out[:, :, 2] = MEDIA_PID & 0xFF
    out[:, :, 3] = (counter + np.arange(n * k, dtype=np.int64).reshape(n, k)) & 15 | 0x10
    out[:, 0, 3] |= 0x20
    out[:, 0, 4:6] = (ADAPTATION - 1, 0x50)
    out[:, 0, 6:12] = _clock((pts - CLOCK_LEAD) & (2**33 - 1))
    out[:, 0, 12:] = whole[:, :lead]
    middle = k - 2
    out[:, 1 : k - 1, 4:] = whole[:, lead : lead + 184 * middle].reshape(n, middle, 184)
    last = rest - 184 * middle
    if stuffing := 184 - last:
        out[:, -1, 3] |= 0x20
        out[:, -1, 4] = stuffing - 1
        out[:, -1, 5 : 4 + stuffing] = 0xFF
        if stuffing > 1:
            out[:, -1, 5] = 0  # the flags; a single byte of stuffing is the length alone
    out[:, -1, 188 - last :] = whole[:, -last:]
    return out.reshape(-1, 188)


def mux(payload: np.ndarray) -> bytes:
    """The transport stream of a payload, a positive multiple of 576 bytes."""
    if not payload.size or payload.size % FRAME_BYTES:
        raise ValueError("a payload is a positive multiple of 576 bytes")
    full = FRAME_BYTES * FRAMES_A_PACKET
    whole = payload.size // full
    pts = (FIRST_PTS + FRAME_TICKS * FRAMES_A_PACKET * np.arange(whole + 1, dtype=np.int64)) & (2**33 - 1)
    out, sent = [], 0
    for group, at in enumerate(range(0, whole + (whole * full < payload.size), TABLES_EVERY)):
        tables = _table_packets().copy()
        tables[:, 3] |= group & 15
        out.append(tables)
        stop = min(whole, at + TABLES_EVERY)
        if stop > at:
            out.append(_elementary(payload[at * full : stop * full].reshape(-1, full), pts[at:stop], sent))
            sent += len(out[-1])
        if whole < at + TABLES_EVERY and whole * full < payload.size:
            out.append(_elementary(payload[None, whole * full :], pts[whole:], sent))
            sent += len(out[-1])
    return np.concatenate(out).tobytes()


# Ids of elementary packets that have no optional header (maps, padding, private 2, messages, directory).
PLAIN_PACKETS = [0xBC, 0xBE, 0xBF, 0xF0, 0xF1, 0xF2, 0xF8, 0xFF]


class Packets:
    """The packets of a stream: their ids, flags, counters and where each one's payload begins."""

    def __init__(self, stream: bytes):
        if not len(stream) or len(stream) % 188:
            raise ValueError("a transport stream is a positive multiple of 188 bytes")
        self.rows = np.frombuffer(stream, np.uint8).reshape(-1, 188)
        if not (self.rows[:, 0] == 0x47).all():
            raise ValueError("a sync byte is missing")
        self.pid = (self.rows[:, 1] & 0x1F).astype(np.int32) << 8 | self.rows[:, 2]
        self.opens = (self.rows[:, 1] & 0x40) > 0
        adapted = (self.rows[:, 3] & 0x20) > 0
        self.begin = np.where(adapted, 5 + self.rows[:, 4].astype(np.int64), 4)
        if (self.begin > 188).any():
            raise ValueError("an adaptation field is longer than its packet")
        self.flags = np.where(adapted & (self.begin > 5), self.rows[:, 5], 0)
        self.filled = ((self.rows[:, 3] & 0x10) > 0) & (self.begin < 188)

    def of(self, pid: int) -> tuple[np.ndarray, int]:
        """Numbers of the packets of an id that carry payload, a repeated one left out, and the counters' errors.

        A packet may be sent twice in a row; counters of packets without payload stay as they were; where a packet
        says that its counter starts anew, any value is right.
        """
        at = np.flatnonzero((self.pid == pid) & self.filled)
        counter = self.rows[at, 3] & 15
        step = (np.diff(counter, prepend=counter[:1] - 1)) & 15
        again = np.zeros(at.size, bool)
        for k in np.flatnonzero(step == 0).tolist():
            a, b = self.rows[at[k - 1]], self.rows[at[k]]
            again[k] = k > 0 and not again[k - 1] and self.begin[at[k]] == self.begin[at[k - 1]] and bool((a[self.begin[at[k]] :] == b[self.begin[at[k]] :]).all())
        errors = (step != 1) & ~again & ((self.flags[at] & 0x80) == 0)
        return at[~again], int(errors.sum())

    def payload(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Payloads of packets laid end to end, and where each begins."""
        own, begin = self.rows[at], self.begin[at]
        keep = np.ones(own.shape, bool)
        keep[:, :4] = False
        short = np.flatnonzero(begin > 4)
        keep[short] = np.arange(188) >= begin[short, None]
        return own.ravel()[keep.ravel()], np.cumsum(188 - begin) - (188 - begin)

    def sections(self, at: np.ndarray) -> Iterator[bytes]:
        """The table sections in packets, whole over several of them; one whose CRC is wrong fails."""
        held: bytes | None = None
        for k in at.tolist():
            data = self.rows[k, self.begin[k] :].tobytes()
            parts = [data] if not self.opens[k] else [data[1 : 1 + data[0]], data[1 + data[0] :]]
            for i, part in enumerate(parts):
                held = part if i else (held + part if held is not None else None)
                while held and len(held) >= 3 and held[0] != 0xFF:
                    size = 3 + (int.from_bytes(held[1:3], "big") & 0xFFF)
                    if len(held) < size:
                        break
                    if section_crc(held[:size]):
                        raise ValueError(f"the table on packet id {int(self.pid[k])} is damaged")
                    if held[5] & 1:
                        yield held[:size]
                    held = held[size:]


def _timestamp(head: np.ndarray, at: int) -> np.ndarray:
    b = head[:, at : at + 5]
    return (b[:, 0] & 0x0E) << 29 | b[:, 1] << 22 | (b[:, 2] & 0xFE) << 14 | b[:, 3] << 7 | b[:, 4] >> 1


def _reassembled(packets: Packets, at: np.ndarray) -> dict:
    """Payload, timestamps and random-access points of one elementary stream.

    ``pts`` and ``dts`` have an entry for each elementary packet, -1 where it has none. Bytes before the first start
    belong to no packet and are left out.
    """
    data, begins = packets.payload(at)
    opens = packets.opens[at]
    starts = begins[opens]
    head = np.zeros((starts.size, 19), np.int64)
    where = starts[:, None] + np.arange(19)
    inside = where < data.size
    head[inside] = data[where[inside]]
    if (head[:, :3] != (0, 0, 1)).any():
        raise ValueError("an elementary packet has no start code")
    sizes = np.diff(np.append(starts, data.size))
    stated = head[:, 4] << 8 | head[:, 5]
    if ((stated > 0) & (sizes != stated + 6)).any():
        raise ValueError("an elementary packet is not whole")
    plain = np.isin(head[:, 3], PLAIN_PACKETS)
    length = np.where(plain, 6, 9 + head[:, 8])
    if (length > sizes).any():
        raise ValueError("a header is longer than its elementary packet")
    shift = np.zeros(data.size + 1, np.int64)
    np.add.at(shift, starts, 1)
    np.add.at(shift, starts + length, -1)
    body = np.cumsum(shift[:-1]) == 0
    body[: int(starts[0]) if starts.size else data.size] = False
    pts = np.where(~plain & ((head[:, 7] & 0x80) > 0), _timestamp(head, 9), -1)
    dts = np.where(~plain & ((head[:, 7] & 0xC0) == 0xC0), _timestamp(head, 14), -1)
    access = (packets.flags[at[opens]] & 0x40) > 0
    return {"payload": data[body], "pts": pts, "dts": dts, "access_offset": at[opens][access] * 188, "access_pts": pts[access]}


def demux(stream: bytes) -> dict:
    """``packets``, ``errors`` (of counters) and ``streams``: each program's elementary streams in the tables' order.

    A stream has ``program``, ``pid``, ``kind`` (the stream type of its table), ``payload``, ``pts``, ``dts`` and its
    random-access points (``access_offset`` in bytes, ``access_pts``).
    """
    packets = Packets(stream)
    at, errors = packets.of(0)
    programs: dict[int, int] = {}
    for section in packets.sections(at):
        for k in range(8, len(section) - 4, 4):
            if number := int.from_bytes(section[k : k + 2], "big"):  # 0 names the network
                programs[number] = int.from_bytes(section[k + 2 : k + 4], "big") & 0x1FFF
    if not programs:
        raise ValueError("no program table")
    found: dict[tuple[int, int], int] = {}
    for pid in dict.fromkeys(programs.values()):
        at, wrong = packets.of(pid)
        errors += wrong
        for section in packets.sections(at):
            if section[0] != 2:
                continue
            number, k = int.from_bytes(section[3:5], "big"), 12 + (int.from_bytes(section[10:12], "big") & 0xFFF)
            while k < len(section) - 4:
                found[number, int.from_bytes(section[k + 1 : k + 3], "big") & 0x1FFF] = section[k]
                k += 5 + (int.from_bytes(section[k + 3 : k + 5], "big") & 0xFFF)
    if not found:
        raise ValueError("no table of a program")
    streams = []
    for (number, pid), kind in found.items():
        at, wrong = packets.of(pid)
        errors += wrong
        streams.append({"program": number, "pid": pid, "kind": kind} | _reassembled(packets, at))
    return {"packets": len(packets.rows), "errors": errors, "streams": streams}


# ---------------------------------------------------------------- the operators


def store(df: DataFrame, *, data: str = "data", media: str = "media") -> DataFrame:
    """``df`` with a binary column of transport streams instead of its binary column ``data``.

    The bytes (null: empty) are padded with 255 to a positive multiple of 576; ``<media>_bytes`` keeps their number
    before. Equal bytes give equal streams. Other columns stay; those of the outputs' names are replaced.
    """
    made = (media, f"{media}_bytes")
    kept = [c for c in df.columns if c not in (data, *made)]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*kept).schema]

    def run(batches):
        for batch in batches:
            for start, stop in byte_slices(lengths_of(batch.column(len(kept))), BATCH_BYTES):
                part = batch.slice(start, stop - start)
                streams, sizes = [], []
                for value in part.column(len(kept)):
                    raw = b"" if not value.is_valid else value.as_buffer()
                    size = len(raw)
                    payload = np.full(max(1, -(-size // FRAME_BYTES)) * FRAME_BYTES, 255, np.uint8)
                    payload[:size] = np.frombuffer(raw, np.uint8)
                    streams.append(mux(payload))
                    sizes.append(size)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(kept))), pa.array(streams, pa.binary()), pa.array(sizes, pa.int64())], names=[*kept, *made])

    return df.select(*kept, data).mapInArrow(run, ", ".join([*fields, f"`{media}` binary, `{media}_bytes` long"]))


def load(df: DataFrame, *, media: str = "media", stream: int = 0) -> DataFrame:
    """``df`` with what its streams hold: ``payload``, ``packets``, ``counter_errors``, ``pts``, ``random_access`` and
    ``streams``.

    Payload, timestamps (null where an elementary packet has none) and random-access points are those of the elementary
    stream of that number, in the order of the program tables; ``streams`` lists all of them. Where there is no such
    stream, they are null. A damaged stream (sync, table, header, length) fails the job; counter errors are counted.
    Null streams give nulls. Batches are cut by bytes; one media value is held whole.
    """
    made = ["payload", "packets", "counter_errors", "pts", "random_access", "streams"]
    kept = [c for c in df.columns if c not in made]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*kept).schema]
    point = pa.list_(pa.struct([("offset", pa.int64()), ("pts", pa.int64())]))
    listed = pa.list_(pa.struct([("program", pa.int32()), ("pid", pa.int32()), ("kind", pa.int32()), ("bytes", pa.int64())]))
    stamp = lambda ticks: [t if t >= 0 else None for t in ticks.tolist()]

    def run(batches):
        for batch in batches:
            column = batch.column(kept.index(media))
            for start, stop in byte_slices(lengths_of(column), BATCH_BYTES):
                part = batch.slice(start, stop - start)
                found = [demux(v.as_buffer()) if v.is_valid else None for v in part.column(kept.index(media))]
                own = [x["streams"][stream] if x is not None and stream < len(x["streams"]) else None for x in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(i) for i in range(len(kept))),
                        pa.array([None if x is None else x["payload"].tobytes() for x in own], pa.binary()),
                        pa.array([None if x is None else x["packets"] for x in found], pa.int64()),
                        pa.array([None if x is None else x["errors"] for x in found], pa.int64()),
                        pa.array([None if x is None else stamp(x["pts"]) for x in own], pa.list_(pa.int64())),
                        pa.array([None if x is None else [{"offset": o, "pts": t} for o, t in zip(x["access_offset"].tolist(), stamp(x["access_pts"]), strict=True)] for x in own], point),
                        pa.array([None if x is None else [{"program": s["program"], "pid": s["pid"], "kind": s["kind"], "bytes": s["payload"].size} for s in x["streams"]] for x in found], listed),
                    ],
                    names=[*kept, *made],
                )

    schema = "payload binary, packets long, counter_errors long, pts array<long>, random_access array<struct<offset:long,pts:long>>, streams array<struct<program:int,pid:int,kind:int,bytes:long>>"
    return df.select(*kept).mapInArrow(run, ", ".join([*fields, schema]))
