"""Ogg media columns: a multiplexer and a verifying demultiplexer for logical streams of packets.

Reading checks each page's checksum and sequence number, reassembles packets from lacing values (also
packets that go on over pages), separates logical streams by serial number, and gives each page's time
from its granule position and the stream's rate.

A text is stored as an unsigned 8-bit PCM stream of one channel (one sample for each payload byte) beside
a second logical stream of marks (one packet for each second of sound).  Nothing depends on doc_id: equal
texts give equal media.

Defined cases: a null text counts as empty; an empty text is 64 zero bytes; texts of any length are
written page by page; repeated rows each give their row; an empty table gives an empty result; damaged
media raise OggError naming the fault (with on_error="null" the row's read columns are null instead).
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesframe.llm import textcols as tc
from seriesframe.llm.tables import small_batches

RATE = 8000
PACKET = 16000  # samples of a packet: 63 lacing values, so that packets cross pages
BLOCK = 64  # payload bytes come in multiples of it

_CONTINUED, _FIRST, _LAST = 1, 2, 4
_HEADER = "<4sBBqIIIB"
#: Of every byte, the bits in reverse order.
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


class OggError(ValueError):
    pass


def checksum(page: bytes) -> int:
    """Ogg's CRC-32 (polynomial 0x04C11DB7, most significant bit first, nothing inverted).

    With all bits in reverse order this is zlib's CRC without its inversions.
    """
    value = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(value.to_bytes(4, "big").translate(_REVERSED), "little")


@dataclass
class Page:
    serial: int
    number: int
    granule: int
    flags: int
    lacing: bytes
    body: bytes

    def encode(self) -> bytes:
        head = struct.pack(_HEADER, b"OggS", 0, self.flags, self.granule, self.serial, self.number, 0, len(self.lacing)) + self.lacing
        crc = checksum(head + self.body)
        return head[:22] + struct.pack("<I", crc) + head[26:] + self.body


def paginate(serial: int, packets: list[tuple[bytes, int]]) -> list[Page]:
    """Pages of one logical stream; packets are (bytes, granule position at their end).

    The first packet (the header that names the codec) has a page of its own.  A page on which no packet ends has granule -1.
    """
    pages: list[Page] = []

    def put(lacing: list[int], body: list[bytes], granule: int, continued: bool) -> None:
        pages.append(Page(serial, len(pages), granule, _CONTINUED * continued, bytes(lacing), b"".join(body)))

    lacing: list[int] = []
    body: list[bytes] = []
    granule, continued = -1, False
    for i, (data, end) in enumerate(packets):
        left, at = len(data), 0
        while True:
            room = 255 - len(lacing)
            full = min(left // 255, room)
            lacing += [255] * full
            body.append(data[at : at + 255 * full])
            at, left, room = at + 255 * full, left - 255 * full, room - full
            if room and left < 255:  # the value that ends the packet, 0 included
                lacing.append(left)
                body.append(data[at:])
                granule = end
                break
            put(lacing, body, granule, continued)
            lacing, body, granule, continued = [], [], -1, True
        if i == 0 or len(lacing) == 255:
            put(lacing, body, granule, continued)
            lacing, body, granule, continued = [], [], -1, False
    if lacing:
        put(lacing, body, granule, continued)
    pages[0].flags |= _FIRST
    pages[-1].flags |= _LAST
    return pages


def multiplex(streams: list[list[Page]], rates: list[int]) -> bytes:
    """All first pages, then the rest by time; a page without a granule position follows its stream's last one."""
    heads, rest = [s[0] for s in streams], []
    for k, (pages, rate) in enumerate(zip(streams, rates, strict=True)):
        time = 0.0
        for i, page in enumerate(pages[1:]):
            time = max(time, page.granule / rate) if page.granule >= 0 else time
            rest.append((time, k, i, page))
    return b"".join(p.encode() for p in heads) + b"".join(x[3].encode() for x in sorted(rest, key=lambda x: x[:3]))


@dataclass
class Stream:
    serial: int
    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)  # of pages on which a packet ends
    ends: list[int] = field(default_factory=list)  # packets complete by then
    pages: int = 0
    continued: int = 0
    complete: bool = False
    _open: list[bytes] | None = None

    def times(self, rate: int) -> list[float]:
        """Seconds from the stream's start, for each page on which a packet ends."""
        return [g / rate for g in self.granules]


def demultiplex(media: bytes) -> dict[int, Stream]:
    """Logical streams by serial number, in the order of their first pages."""
    streams: dict[int, Stream] = {}
    at, end = 0, len(media)
    while at < end:
        if end - at < 27 or media[at : at + 4] != b"OggS":
            raise OggError(f"no page at byte {at}")
        _, version, flags, granule, serial, number, crc, count = struct.unpack_from(_HEADER, media, at)
        lacing = media[at + 27 : at + 27 + count]
        size = sum(lacing)
        body_at = at + 27 + count
        if version or len(lacing) < count or body_at + size > end:
            raise OggError(f"cut or unknown page at byte {at}")
        if checksum(media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : body_at + size]) != crc:
            raise OggError(f"wrong checksum of the page at byte {at}")
        stream = streams.get(serial)
        if (stream is None) != bool(flags & _FIRST):
            raise OggError(f"stream {serial} starts twice or not at all")
        if stream is None:
            stream = streams[serial] = Stream(serial)
        if stream.complete or number != stream.pages:
            raise OggError(f"page {number} of stream {serial} is out of order")
        if bool(flags & _CONTINUED) != (stream._open is not None):
            raise OggError(f"page {number} of stream {serial} doesn't go on where the last one ended")
        stream.pages += 1
        stream.continued += flags & _CONTINUED
        ended, start, stop = False, body_at, body_at
        for value in lacing:
            stop += value
            if value < 255:
                part, start = media[start:stop], stop
                stream.packets.append(b"".join([*stream._open, part]) if stream._open is not None else part)
                stream._open, ended = None, True
        if lacing and lacing[-1] == 255:
            stream._open = [*(stream._open or []), media[start:stop]]
        if ended:
            stream.granules.append(granule)
            stream.ends.append(len(stream.packets))
        stream.complete = bool(flags & _LAST)
        at = stop
    for stream in streams.values():
        if not stream.complete or stream._open is not None:
            raise OggError(f"stream {stream.serial} has no end")
    return streams


def payload_of(text: bytes) -> bytes:
    return text + bytes(-len(text) % BLOCK if text else BLOCK)


def store(payload: bytes) -> bytes:
    """The payload as samples of a PCM stream, beside a stream of marks."""
    serial = zlib.crc32(payload)
    other = serial ^ 0x5EC0
    sound = [(b"PCM     " + struct.pack(">HHIIBBHII", 0, 0, 1, RATE, 8, 1, 0, PACKET, 0), 0)]
    sound += [(payload[i : i + PACKET], min(i + PACKET, len(payload))) for i in range(0, len(payload), PACKET)]
    marks = [(b"MARKS   " + struct.pack(">I", 1), 0)]
    marks += [(b"second %d crc %08x" % (k, zlib.crc32(payload[k * RATE : (k + 1) * RATE])), k + 1) for k in range(-(-len(payload) // RATE))]
    return multiplex([paginate(serial, sound), paginate(other, marks)], [RATE, 1])


def load(media: bytes) -> tuple[bytes, dict[int, Stream]]:
    """The payload, read back from the stream whose header says PCM; the marks must agree with it."""
    streams = demultiplex(media)
    sound = [s for s in streams.values() if s.packets and s.packets[0][:8] == b"PCM     "]
    marks = [s for s in streams.values() if s.packets and s.packets[0][:8] == b"MARKS   "]
    if len(sound) != 1 or len(marks) != 1:
        raise OggError("no single PCM stream with its marks")
    payload = b"".join(sound[0].packets[1:])
    if sound[0].granules[-1] != len(payload):
        raise OggError(f"{len(payload)} samples, but the last granule position is {sound[0].granules[-1]}")
    for k, mark in enumerate(marks[0].packets[1:]):
        if mark != b"second %d crc %08x" % (k, zlib.crc32(payload[k * RATE : (k + 1) * RATE])):
            raise OggError(f"the mark of second {k} doesn't fit the samples")
    return payload, streams


def features_of(payload: bytes, streams: dict[int, Stream]) -> str:
    """Length and counts of the container, and level, zero crossings and spectrum shape of the samples."""
    sound = next(s for s in streams.values() if s.packets[0][:8] == b"PCM     ")
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    crossings = int(((x[1:] < 0) != (x[:-1] < 0)).sum())
    seconds = sound.times(RATE)[-1]
    return (
        f"seconds={seconds:.4f};packets={len(sound.packets) - 1};pages={sum(s.pages for s in streams.values())};continued={sound.continued};"
        f"mean={int(x.sum())}/{len(x)};energy={int((x * x).sum())};crossings={crossings};step={int(np.abs(np.diff(x)).sum())};peak={int(np.abs(x).max())}"
    )


SCHEMA = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_column(docs: DataFrame, *, text: str = "text", media_col: str = "media") -> DataFrame:
    """All columns of docs (but one named media_col) with each text's Ogg bytes."""

    def run(batches):
        for batch in batches:
            column = tc.column(batch, text)
            data, offsets = tc.raw(column)
            media = [store(payload_of(data[a:b].tobytes())) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            arrays = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(media, pa.binary())], [*keep, media_col])

    keep = [c for c in docs.columns if c != media_col]
    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, T.StructType([*(docs.schema[c] for c in keep), T.StructField(media_col, T.BinaryType())]))


def read_media(frame: DataFrame, *, media: str = "media", payload_col: str = "payload", feature_col: str = "feature", on_error: str = "raise") -> DataFrame:
    """Payload and features of Ogg bytes; null media give nulls."""
    keep = [c for c in frame.columns if c not in (payload_col, feature_col)]

    def run(batches):
        for batch in batches:
            out = []
            for m in batch.column(media).to_pylist():
                try:
                    payload, streams = load(m) if m is not None else (None, None)
                    out.append((payload, features_of(payload, streams) if m is not None else None))
                except OggError:
                    if on_error == "raise":
                        raise
                    out.append((None, None))
            arrays = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.string())], [*keep, payload_col, feature_col])

    small_batches(frame.sparkSession)
    return frame.mapInArrow(run, T.StructType([*(frame.schema[c] for c in keep), T.StructField(payload_col, T.BinaryType()), T.StructField(feature_col, T.StringType())]))


def digests(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Store each text, read the stored bytes back and give lengths, digests and features; one row for each row."""

    def run(batches):
        for batch in batches:
            data, offsets = tc.raw(tc.column(batch, "_t"))
            out = []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                media = store(payload_of(data[a:b].tobytes()))
                back, streams = load(media)
                out.append((b - a, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), features_of(back, streams)))
            cols = list(zip(*out, strict=True)) if out else [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", *(x.split()[0] for x in SCHEMA.split(", "))])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("_t"))
    small_batches(rows.sparkSession)
    return rows.mapInArrow(run, f"doc_id long, {SCHEMA}")
