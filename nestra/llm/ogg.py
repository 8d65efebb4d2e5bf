"""Media columns in Ogg: write and read pages, packets and logical streams.

``pages_of`` and ``mux`` write; ``demux`` reads: it verifies each page's checksum, reassembles packets from lacing
values (packets may span pages), sorts them into their logical streams and gives every packet the time at which it
ends: a page's granule position is that of the last packet that ends on it, and those before end earlier by the
samples of the packets after them. Pages that fail their checksum are counted and skipped; a packet with a missing
part is dropped, and reading goes on at the next capture pattern.

``store`` keeps a payload of bytes losslessly: 8-bit samples in blocks that alternate between two logical
streams, each with a head packet. ``load`` reads it back. Both work on one row at a time.

Cases: a null text is empty; an empty text is 64 zero bytes. Equal texts have equal files. Rows stay rows,
repeated or not. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import utf8

CAPTURE = b"OggS"
CONTINUED, FIRST, LAST = 1, 2, 4
RATE, BLOCK, UNIT = 8000, 4096, 64
_HEAD = struct.Struct("<4sBBqIIIB")
_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))
_MAGIC = struct.Struct("<8sBBII")
_NAME = b"pcm8-blk"


def checksum(page: bytes) -> int:
    """CRC-32 of polynomial 0x04C11DB7, most significant bit first, from zero: zlib's on mirrored bits."""
    mirrored = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_REVERSED), "big")


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = _HEAD.pack(CAPTURE, 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    return head[:22] + checksum(head + body).to_bytes(4, "little") + head[26:] + body


def pages_of(serial: int, packets: list[tuple[bytes, int]], most: int = 255) -> list[bytes]:
    """Pages of one logical stream. ``packets`` are (data, granule position at their end); pages hold ``most``
    lacing values at the most, and the first packet stands alone on the first page."""
    pages: list[bytes] = []
    lacing, body, granule, continued = bytearray(), bytearray(), -1, False

    def close(last: bool = False) -> None:
        nonlocal granule, continued
        flags = CONTINUED * continued | FIRST * (not pages) | LAST * last
        pages.append(_page(flags, granule, serial, len(pages), bytes(lacing), bytes(body)))
        continued = bool(lacing) and lacing[-1] == 255
        lacing.clear()
        body.clear()
        granule = -1

    for i, (data, at) in enumerate(packets):
        for start in range(0, len(data) + 1, 255):
            if len(lacing) == most:
                close()
            part = data[start : start + 255]
            lacing.append(len(part))
            body += part
        granule = at
        if i == 0 and len(packets) > 1:
            close()
    close(True)
    return pages


def mux(streams: list[list[bytes]]) -> bytes:
    """One physical stream: all first pages, then the other pages in turn."""
    turns = max(map(len, streams), default=0)
    return b"".join(s[i] for i in range(turns) for s in streams if i < len(s))


@dataclass
class Logical:
    """A logical stream as read: packets, and the seconds at which each ends (None on a page that has no granule position)."""

    packets: list[bytes] = field(default_factory=list)
    seconds: list[float | None] = field(default_factory=list)
    pages: int = 0
    ended: bool = False


def samples_of(packet: bytes) -> int:
    """Samples of a packet of :func:`store`: one a byte, none in the head."""
    return 0 if len(packet) == _MAGIC.size and packet.startswith(_NAME) else len(packet)


def demux(data: bytes, rate: int = RATE, samples: Callable[[bytes], int] = samples_of) -> tuple[dict[int, Logical], int]:
    """Logical streams by serial number, and the number of bad pages. ``samples`` is the codec's length of a packet."""
    streams: dict[int, Logical] = {}
    parts: dict[int, list[bytes] | None] = {}
    expected: dict[int, int] = {}
    bad, at = 0, 0
    while (at := data.find(CAPTURE, at)) >= 0:
        if at + 27 > len(data):
            bad += 1
            break
        _, version, flags, granule, serial, number, crc, n = _HEAD.unpack_from(data, at)
        lacing = data[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        page = data[at:end]
        if version or end > len(data) or checksum(page[:22] + bytes(4) + page[26:]) != crc:
            bad += 1
            at += 1
            continue
        stream = streams.setdefault(serial, Logical())
        stream.pages += 1
        stream.ended |= bool(flags & LAST)
        held = parts.get(serial)
        if number != expected.get(serial, 0) or not flags & CONTINUED:
            held = None
        skip = bool(flags & CONTINUED) and held is None  # the rest of a packet whose start is lost
        expected[serial] = number + 1
        began, cursor, complete = at + 27 + n, at + 27 + n, []
        for size in lacing:
            cursor += size
            if size < 255:
                if not skip:
                    complete.append(b"".join([*(held or []), data[began:cursor]]))
                skip, held, began = False, None, cursor
        if n and lacing[-1] == 255:
            parts[serial] = None if skip else [*(held or []), data[began:cursor]]
        else:
            parts[serial] = None
        ends, upto = [], granule
        for packet in reversed(complete):
            ends.append(upto / rate if granule >= 0 else None)
            upto = max(0, upto - samples(packet))
        stream.packets += complete
        stream.seconds += reversed(ends)
        at = end
    return streams, bad


def store(payload: bytes, block: int = BLOCK, rate: int = RATE) -> bytes:
    """The payload as 8-bit samples: even blocks in the first logical stream, odd ones in the second."""
    streams = []
    for k in range(2):
        packets, samples = [(_MAGIC.pack(_NAME, 2, k, rate, block), 0)], 0
        for start in range(k * block, len(payload), 2 * block):
            part = payload[start : start + block]
            samples += len(part)
            packets.append((part, samples))
        streams.append(pages_of(k + 1, packets))
    return mux(streams)


def load(media: bytes) -> tuple[bytes, dict[int, Logical]]:
    """The payload of :func:`store` and the streams it was read from; raises if a page or a stream is damaged."""
    streams, bad = demux(media)
    ordered: list[list[bytes]] = []
    for serial in sorted(streams):
        head, *blocks = streams[serial].packets
        name, channels, k, _, _ = _MAGIC.unpack(head)
        if bad or name != _NAME or k != len(ordered) or not streams[serial].ended:
            raise ValueError("damaged media")
        ordered.append(blocks)
    if len(ordered) != channels:
        raise ValueError("a logical stream is missing")
    first, second = ordered
    out = [b""] * (len(first) + len(second))
    out[0::2], out[1::2] = first, second
    return b"".join(out), streams


def feature(payload: bytes, streams: dict[int, Logical]) -> str:
    """Counts of the container, its length in seconds, and mean, deviation and mean crossings of the samples."""
    x = np.frombuffer(payload, np.uint8)
    mean = x.mean()
    above = x > mean
    crossings = np.count_nonzero(above[1:] != above[:-1]) / len(x)
    seconds = max(t for s in streams.values() for t in s.seconds if t is not None)
    return (
        f"streams={len(streams)};pages={sum(s.pages for s in streams.values())};packets={sum(len(s.packets) for s in streams.values())};"
        f"seconds={seconds:.6f};mean={mean:.4f};deviation={x.std():.4f};crossings={crossings:.4f}"
    )


def padded(text: bytes) -> bytes:
    return text + bytes(-len(text) % UNIT if text else UNIT)


_FILES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_bytes", T.LongType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_sha256", T.StringType()),
        T.StructField("tail_crc32", T.LongType()),
        T.StructField("media_bytes", T.LongType()),
        T.StructField("media_sha256", T.StringType()),
        T.StructField("feature", T.StringType()),
    ]
)


def media(documents: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text's file."""
    schema = T.StructType([_FILES["doc_id"], _FILES["n_bytes"], T.StructField("media", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), utf8(batch.column(1))
            for start in range(0, len(texts), 256):  # files of a few documents at a time
                part = [t or b"" for t in texts[start : start + 256]]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(start, len(part)), pa.array(map(len, part), pa.int64()), pa.array([store(padded(t)) for t in part], pa.binary())], names=schema.names
                )

    return documents.select("doc_id", "text").mapInArrow(run, schema)


def digest(files: DataFrame) -> DataFrame:
    """What the files of :func:`media` yield when they are read again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for data in batch.column(2):
                data = data.as_py()
                payload, streams = load(data)
                out.append(
                    (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), feature(payload, streams))
                )
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = [pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 6, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=_FILES.names)

    return files.mapInArrow(run, _FILES)
