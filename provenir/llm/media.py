"""Media columns as Ogg: lossless 8-bit sample streams inside checked pages.

A payload is stored as two mono PCM streams (even bytes left, odd bytes right), multiplexed
into one physical Ogg stream.  Reading verifies every page checksum and sequence number,
reassembles packets from lacing values over page borders, demultiplexes by serial number
and derives packet timestamps from granule positions.

Defined cases: null or empty text gives one padded block; equal texts give equal media
(serials and headers are constants, ids are never stored); damaged media raise ``OggError``
in ``demux`` and give a null payload with the reason in ``error`` in ``decode_media``.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from provenir.llm.common import small_batches, table, utf8

BLOCK, RATE, PACKET, PAGE_SEGMENTS, SERIALS = 576, 8000, 1152, 16, (1, 2)
#: Bit-reversed bytes: Ogg's checksum reads bits high to low, zlib's low to high.
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
_HEAD = struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4


class OggError(ValueError):
    """The bytes are no intact Ogg stream."""


def page_checksum(data: bytes) -> int:
    """CRC-32 with polynomial 04C11DB7, no reflection, start 0, no final inversion."""
    low = zlib.crc32(data.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(low.to_bytes(4, "little").translate(_REVERSED), "big")


def _page(serial: int, number: int, flags: int, granule: int, lacing: bytes, body: bytes) -> bytes:
    head = _HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    crc = page_checksum(head + body)
    return head[:22] + crc.to_bytes(4, "little") + head[26:] + body


def pages_of(serial: int, packets: list[tuple[bytes, int]]) -> list[tuple[int, bytes]]:
    """Pages of one logical stream, each with its time; packets are (bytes, end granule)."""
    out: list[tuple[int, bytes]] = []
    lacing, body, granule, flags, time = bytearray(), bytearray(), -1, FIRST, 0

    def flush(last: bool, continues: bool) -> None:
        nonlocal lacing, body, granule, flags
        page_flags = flags | (LAST if last else 0)
        out.append((time, _page(serial, len(out), page_flags, granule, bytes(lacing), bytes(body))))
        lacing, body, granule, flags = bytearray(), bytearray(), -1, CONTINUED if continues else 0

    for i, (packet, end) in enumerate(packets):
        values = [255] * (len(packet) // 255) + [len(packet) % 255]
        at = 0
        for k, value in enumerate(values):
            if len(lacing) == PAGE_SEGMENTS:
                flush(False, k > 0)
            lacing.append(value)
            body += packet[at : at + value]
            at += value
        granule, time = end, end
        if i == 0:  # the first header stands alone on the first page
            flush(len(packets) == 1, False)
    if lacing:
        flush(True, False)
    return out


def mux(payload: bytes, rate: int = RATE) -> bytes:
    """Store the bytes as unsigned 8-bit samples in two multiplexed streams."""
    logical = []
    for channel, serial in enumerate(SERIALS):
        samples = payload[channel::2]
        header = b"PCM     " + struct.pack(">HHIIBBHI", 0, 0, 1, rate, 8, 1, PACKET, 0)
        data = [(samples[i : i + PACKET], min(i + PACKET, len(samples))) for i in range(0, len(samples), PACKET)]
        logical.append(pages_of(serial, [(header, 0), *data]))
    firsts = [pages[0][1] for pages in logical]
    rest = sorted(((time, s, i, page) for s, pages in enumerate(logical) for i, (time, page) in enumerate(pages) if i), key=lambda x: x[:3])
    return b"".join(firsts) + b"".join(x[3] for x in rest)


def read_pages(data: bytes) -> Iterator[tuple[int, int, int, int, bytes, bytes]]:
    """(serial, number, flags, granule, lacing, body) of each page, checksum verified."""
    at = 0
    while at < len(data):
        if len(data) < at + 27:
            raise OggError("cut page header")
        magic, version, flags, granule, serial, number, crc, n = _HEAD.unpack_from(data, at)
        if magic != b"OggS" or version:
            raise OggError(f"no page at byte {at}")
        lacing = data[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        if len(lacing) < n or end > len(data):
            raise OggError("cut page")
        if page_checksum(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            raise OggError(f"checksum of page {number} of stream {serial}")
        yield serial, number, flags, granule, lacing, data[at + 27 + n : end]
        at = end


def demux(data: bytes) -> dict[int, dict]:
    """Logical streams by serial: rate, packets with their start times in seconds, pages."""
    streams: dict[int, dict] = {}
    for serial, number, flags, granule, lacing, body in read_pages(data):
        if serial not in streams:
            if not flags & FIRST:
                raise OggError(f"stream {serial} has no first page")
            streams[serial] = {"packets": [], "granules": [], "open": None, "pages": 0, "ended": False}
        s = streams[serial]
        if number != s["pages"] or s["ended"]:
            raise OggError(f"page order of stream {serial}")
        if bool(flags & CONTINUED) != (s["open"] is not None):
            raise OggError(f"continuation in stream {serial}")
        s["pages"] += 1
        s["ended"] = bool(flags & LAST)
        part, at, done = s["open"] or b"", 0, 0
        s["open"] = None
        for value in lacing:
            part += body[at : at + value]
            at += value
            if value < 255:
                s["packets"].append(part)
                part, done = b"", done + 1
        if lacing and lacing[-1] == 255:
            s["open"] = part
        if done:
            # the page's granule is the end of its last packet; earlier ones count back
            ends = [granule] * done
            for k in range(done - 2, -1, -1):
                ends[k] = ends[k + 1] - len(s["packets"][len(s["packets"]) - done + k + 1])
            s["granules"] += ends
        elif granule != -1:
            raise OggError("granule on a page where no packet ends")
    for serial, s in streams.items():
        if s["open"] is not None or not s["ended"]:
            raise OggError(f"stream {serial} is cut")
        header = s["packets"][0]
        if header[:8] != b"PCM     ":
            raise OggError(f"stream {serial} holds no PCM")
        s["rate"] = struct.unpack_from(">I", header, 16)[0]
        s["packets"], s["granules"] = s["packets"][1:], s["granules"][1:]
        s["starts"] = [(g - len(p)) / s["rate"] for g, p in zip(s["granules"], s["packets"], strict=True)]
        if [g - len(p) for g, p in zip(s["granules"], s["packets"], strict=True)] != [0, *s["granules"][:-1]][: len(s["granules"])]:
            raise OggError(f"granules of stream {serial} leave a gap")
    return streams


def payload_of(streams: dict[int, dict]) -> bytes:
    """Interleave the channels again, in order of serial."""
    channels = [np.frombuffer(b"".join(s["packets"]), np.uint8) for _, s in sorted(streams.items())]
    if len({len(c) for c in channels}) != 1:
        raise OggError("channels differ in length")
    return np.stack(channels, 1).tobytes()


def features(streams: dict[int, dict]) -> str:
    """Exact integers per stream: pages, packets, microseconds, sum, energy, crossings, peak."""
    out = []
    for serial, s in sorted(streams.items()):
        x = np.frombuffer(b"".join(s["packets"]), np.uint8).astype(np.int64) - 128
        crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
        micros = s["granules"][-1] * 1_000_000 // s["rate"]
        out.append(f"{serial}:{s['pages']},{len(s['packets'])},{micros},{x.sum()},{(x * x).sum()},{crossings},{np.abs(x).max()}")
    return ";".join(out)


def padded(text: bytes, block: int = BLOCK) -> bytes:
    size = max(1, -(-len(text) // block)) * block
    return text + b"\xff" * (size - len(text))


def encode_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each text as an Ogg file. Other columns are ignored."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch, text_col)
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col), pa.array([len(t) for t in texts], pa.int64()), pa.array([mux(padded(t)) for t in texts], pa.binary())],
                [id_col, "n_bytes", "media"],
            )

    return df.select(id_col, text_col).mapInArrow(run, f"{id_col} long, n_bytes long, media binary")


def decode_media(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Read ``media`` back: payload digests, features, and an error instead for damaged media."""
    small_batches(df.sparkSession)
    schema = f"{id_col} long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, seconds double, error string"

    def one(media: bytes) -> tuple:
        own = (len(media), hashlib.sha256(media).hexdigest())
        try:
            streams = demux(media)
            payload = payload_of(streams)
        except OggError as e:
            return None, None, None, *own, None, None, str(e)
        seconds = max(s["granules"][-1] / s["rate"] for s in streams.values())
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), *own, features(streams), seconds, None

    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [one(m or b"") for m in batch.column("media").to_pylist()]
            columns = list(zip(*rows, strict=True)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col), batch.column("n_bytes"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))],
                [x.split()[0] for x in schema.split(", ")],
            )

    return df.select(id_col, "n_bytes", "media").mapInArrow(run, schema)


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode_media(encode_media(table(spark, sf_dir, "documents"))).drop("error")
