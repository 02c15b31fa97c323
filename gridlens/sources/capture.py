"""Capture files as a data source: ``spark.read.format("capture")`` and ``spark.readStream.format("capture")``.

A file is cut into byte ranges, one partition each; nothing is read to plan that. A range that doesn't begin at the head of its file looks for the first
place from which a chain of plausible record headers leads on, and reads the records that begin inside it, once. After a broken record it looks for the next chain in the same way.
Each range also gives a row about itself: its first record, and where the record after its last one begins. Ranges of a file must agree on that;
``pcap.read_captures`` compares them and reads again those that took payload for a header, so what comes out is what a reader from end to end would give.

The newer block format refers to tables earlier in the file, so such a file is one partition, read through a window of bounded size. A stream takes whole files, by their time
of change; files must be moved into the folder when they are finished. The bound on a record is the snap length in the file's head.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from gridlens.sources.files import listed, open_file

# The four magic numbers of capture files as (byte order, ticks per microsecond), and of the block format.
MAGIC = {
    b"\xd4\xc3\xb2\xa1": ("<", 1), b"\xa1\xb2\xc3\xd4": (">", 1),
    b"\x4d\x3c\xb2\xa1": ("<", 1000), b"\xa1\xb2\x3c\x4d": (">", 1000),
}
SECTION, BYTE_ORDER = b"\x0a\x0d\x0d\x0a", {b"\x4d\x3c\x2b\x1a": "<", b"\x1a\x2b\x3c\x4d": ">"}
INTERFACE, OLD_PACKET, SIMPLE_PACKET, PACKET = 1, 2, 3, 6
BLOCK_TYPES = (INTERFACE, OLD_PACKET, SIMPLE_PACKET, 4, 5, PACKET, 0x0A0D0D0A)
TIME_UNIT, TIME_OFFSET = 9, 14
HEADER, RECORD, ETHERNET = 24, 16, 1

SCHEMA = "path string, range_start long, range_stop long, offset long, ts_us long, length long, data binary, next long, status string, error string"
SPLIT_BYTES = 64 << 20
#: Bytes of a read, and of one step of the search for a chain.
WINDOW, STEP = 8 << 20, 1 << 20
#: Headers that make a chain, and the least packet that a chain may have.
CHAIN, LEAST = 6, 14
#: The largest record where the file doesn't say, and seconds that records of a file may lie apart.
LARGEST, APART = 1 << 28, 20 * 365 * 86_400
#: Rows and bytes of a batch.
ROWS, BYTES = 4_096, 16 << 20


class Window:
    """A file through a buffer."""

    def __init__(self, file, size: int):
        self.file, self.size, self.at, self.block = file, size, 0, b""

    def get(self, at: int, n: int) -> bytes:
        """``n`` bytes, fewer at the end; reading goes on from here."""
        if not self.at <= at <= at + n <= self.at + len(self.block):
            self.file.seek(at)
            self.at, self.block = at, self.file.read(max(n, WINDOW))
        return self.block[at - self.at: at - self.at + n]

    def peek(self, at: int, n: int) -> bytes:
        """The same, without moving the buffer."""
        if self.at <= at <= at + n <= self.at + len(self.block):
            return self.block[at - self.at: at - self.at + n]
        self.file.seek(at)
        return self.file.read(n)


@dataclass
class Records:
    """How the records of a file are written."""

    order: str
    ticks: int
    bound: int
    second: int | None

    def header(self, raw: bytes) -> tuple[int, int, int, int]:
        return struct.unpack(self.order + "IIII", raw)

    def plausible(self, seconds: int, fraction: int, size: int, whole: int) -> bool:
        near = self.second is None or abs(seconds - self.second) <= APART
        return near and fraction < 1_000_000 * self.ticks and size <= self.bound and whole <= LARGEST

    def follows(self, w: Window, at: int) -> bool:
        """Whether a record, or the end of the file, can be at a place."""
        raw = w.peek(at, RECORD) if at <= w.size else b""
        return at == w.size or (len(raw) == RECORD and self.plausible(*self.header(raw)))

    def chain(self, w: Window, at: int) -> bool:
        for _ in range(CHAIN):
            if at == w.size:
                return True
            raw = w.peek(at, RECORD)
            if len(raw) < RECORD or not self.plausible(*self.header(raw)):
                return False
            at += RECORD + self.header(raw)[2]
        return at <= w.size

    def search(self, w: Window, start: int, stop: int) -> int | None:
        """The first place in a range from which a chain leads on."""
        kind = np.dtype(self.order + "u4")
        for at in range(start, stop, STEP):
            raw = w.peek(at, min(STEP, stop - at) + RECORD - 1)
            n = len(raw) - RECORD + 1
            if n <= 0:
                return None
            numbers = [np.ndarray((n,), kind, raw, shift, (1,)).astype(np.int64) for shift in (0, 4, 8, 12)]
            seconds, fraction, size, whole = numbers
            good = (size >= LEAST) & (size <= self.bound) & (fraction < 1_000_000 * self.ticks) & (whole <= LARGEST)
            if self.second is not None:
                good &= np.abs(seconds - self.second) <= APART
            for place in np.flatnonzero(good).tolist():
                if self.chain(w, at + place):
                    return at + place
        return None

    def read(self, w: Window, start: int, stop: int, first: int | None) -> Iterator[tuple]:
        """Packets (offset, time, length, data) that begin in a range, and in the end (first, next, error)."""
        at = first if first is not None else HEADER if start == 0 else self.search(w, start, stop)
        begun, error = at if at is not None and at < stop else None, None
        while at is not None and at < min(stop, w.size):
            raw = w.get(at, RECORD)
            if len(raw) < RECORD:
                at, error = w.size, error or "truncated record"
                break
            seconds, fraction, size, whole = self.header(raw)
            after = at + RECORD + size
            if not self.plausible(seconds, fraction, size, whole) and not self.follows(w, after):
                at, error = self.search(w, at + 1, stop), error or "bad record"
            elif after > w.size:
                lost = self.search(w, at + 1, stop)  # a length that is wrong, if records go on before the end
                at, error = (w.size if lost is None else lost), error or ("truncated record" if lost is None else "bad record")
            else:
                yield at, seconds * 1_000_000 + fraction // self.ticks, whole, w.get(at + RECORD, size)
                at = after
        yield begun, at, error


def blocks(w: Window) -> Iterator[tuple]:
    """Packets (offset, time, length, data) of a file of blocks, and in the end (first, next, error)."""
    at, order, interfaces, error = 0, "<", [], None
    while at < w.size:
        head = w.get(at, 12)
        if head[:4] == SECTION and head[8:12] in BYTE_ORDER:
            order, interfaces = BYTE_ORDER[head[8:12]], []
        kind, size = struct.unpack(order + "II", head[:8]) if len(head) == 12 else (0, 0)
        whole = 12 <= size <= LARGEST and size % 4 == 0 and at + size <= w.size
        if not whole or w.peek(at + size - 4, 4) != struct.pack(order + "I", size):
            following = _next_block(w, at + 4, order)
            error, at = error or ("truncated record" if following is None else "bad record"), w.size if following is None else following
            continue
        if kind == INTERFACE:
            interfaces.append(_interface(w.get(at, size), order))
        elif kind in (PACKET, OLD_PACKET) and size >= 32:
            body = w.get(at, size)
            number = struct.unpack_from(order + ("I" if kind == PACKET else "H"), body, 8)[0]
            high, low, kept, length = struct.unpack_from(order + "IIII", body, 12)
            link, per_second, offset, _ = interfaces[number] if number < len(interfaces) else (None, 1, 0, 0)
            if link != ETHERNET:
                error = error or ("link type is not Ethernet" if link is not None else "unknown interface")
            else:
                yield at, ((high << 32) + low) * 1_000_000 // per_second + offset * 1_000_000, length, body[28: 28 + min(kept, size - 32)]
        elif kind == SIMPLE_PACKET and size >= 16 and interfaces:
            body, (link, _, _, snap) = w.get(at, size), interfaces[0]
            length = struct.unpack_from(order + "I", body, 8)[0]
            if link == ETHERNET:
                yield at, None, length, body[12: 12 + min(length, size - 16, snap or size)]
        at += size
    yield 0, w.size, error


def _interface(body: bytes, order: str) -> tuple[int, int, int, int]:
    """(link type, ticks per second, seconds added, snap length)."""
    link, snap = struct.unpack_from(order + "H", body, 8)[0], struct.unpack_from(order + "I", body, 12)[0]
    at, per_second, offset = 16, 1_000_000, 0
    while at + 4 <= len(body) - 4:
        code, n = struct.unpack_from(order + "HH", body, at)
        if code == 0:
            break
        value = body[at + 4: at + 4 + n]
        if code == TIME_UNIT and n == 1:
            per_second = 1 << (value[0] & 127) if value[0] & 128 else 10 ** value[0]
        elif code == TIME_OFFSET and n == 8:
            offset = struct.unpack(order + "q", value)[0]
        at += 4 + (n + 3) // 4 * 4
    return link, per_second, offset, snap


def _next_block(w: Window, at: int, order: str) -> int | None:
    """The next place at which a block of a known type has its length at both ends."""
    for start in range(at, w.size, STEP):
        raw = w.peek(start, min(STEP, w.size - start) + 7)
        n = len(raw) // 4 - 1
        if n <= 0:
            return None
        words = np.frombuffer(raw[: 4 * (n + 1)], order + "u4")
        good = np.isin(words[:-1], BLOCK_TYPES) & (words[1:] >= 12) & (words[1:] % 4 == 0) & (words[1:] <= LARGEST)
        for i in np.flatnonzero(good).tolist():
            place, size = start + 4 * i, int(words[i + 1])
            if place + size <= w.size and w.peek(place + size - 4, 4) == struct.pack(order + "I", size):
                return place
    return None


def _contents(w: Window, start: int, stop: int, first: int | None) -> Iterator[tuple]:
    """Packets of a range and then (first, next, error, status)."""
    head = w.peek(0, HEADER + 4)
    if head[:4] == SECTION:  # the first range reads all of it
        found = blocks(w) if start == 0 else iter([(None, None, None)])
    elif head[:4] not in MAGIC or len(head) < HEADER:
        known = head[:4] in MAGIC or len(head) < 4
        yield None, None, "truncated header" if known else "no capture file", "failed"
        return
    else:
        order, ticks = MAGIC[head[:4]]
        snap, link = struct.unpack(order + "II", head[16:24])
        if link != ETHERNET:
            yield None, None, "link type is not Ethernet", "failed"
            return
        second = struct.unpack(order + "I", head[24:28])[0] if len(head) == 28 else None
        found = Records(order, ticks, snap if 0 < snap <= LARGEST else LARGEST, second).read(w, start, stop, first)
    for row in found:
        yield row if len(row) == 4 else (*row, "partial" if row[2] else "ok")


def arrow_schema() -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in SCHEMA.split(", ")])


def read_range(path: str, size: int, start: int, stop: int, first: int | None = None) -> Iterator[pa.RecordBatch]:
    """The packets of one byte range, and a row about the range, whatever its file holds."""
    schema, rows, held = arrow_schema(), [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(schema.types)], schema=schema)

    try:
        with open_file(path) as file:
            waiting = None
            for row in _contents(Window(file, size), start, stop, first):
                if waiting is not None:
                    at, time, length, data = waiting
                    rows.append((path, start, stop, at, time, length, data, None, None, None))
                    held += len(data)
                    if len(rows) >= ROWS or held >= BYTES:
                        yield batch()
                        rows, held = [], 0
                waiting = row
            begun, after, error, status = waiting
            rows.append((path, start, stop, begun, None, None, None, after, status, error))
    except Exception as problem:  # a file that can't be opened or read is a reject, not the end of the job
        rows.append((path, start, stop, None, None, None, None, None, "failed", f"{type(problem).__name__}: {problem}"[:200]))
    yield batch()


@dataclass
class ByteRange(InputPartition):
    path: str
    size: int
    start: int
    stop: int


class _Files:
    def __init__(self, options):
        self.folder, self.split = options["path"], int(options.get("splitBytes", SPLIT_BYTES))
        self.patterns = options.get("pattern", "*.pcap,*.pcapng").split(",")

    def read(self, part: ByteRange) -> Iterator[pa.RecordBatch]:
        yield from read_range(part.path, part.size, part.start, part.stop)


class CaptureReader(_Files, DataSourceReader):
    def partitions(self) -> list[ByteRange]:
        return [
            ByteRange(path, size, start, min(start + self.split, max(size, 1)))
            for path, size, _ in listed(self.folder, self.patterns) for start in range(0, max(size, 1), self.split)]


class CaptureStream(_Files, DataSourceStreamReader):
    """An offset is the time of change and the name of the last file that was taken."""

    def initialOffset(self) -> dict:
        return {"time": 0, "path": ""}

    def latestOffset(self) -> dict:
        time, path = max(((t, p) for p, _, t in listed(self.folder, self.patterns)), default=(0, ""))
        return {"time": time, "path": path}

    def partitions(self, start: dict, end: dict) -> list[ByteRange]:
        after, upto = (start["time"], start["path"]), (end["time"], end["path"])
        return [ByteRange(path, size, 0, max(size, 1)) for path, size, t in listed(self.folder, self.patterns) if after < (t, path) <= upto]


class CaptureSource(DataSource):
    """Options: path (a folder or a file), pattern (names, by commas), splitBytes."""

    @classmethod
    def name(cls) -> str:
        return "capture"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CaptureReader:
        return CaptureReader(self.options)

    def streamReader(self, schema) -> CaptureStream:
        return CaptureStream(self.options)
