"""Media columns: 8-bit samples in Ogg pages, written and read back with every check.

``to_media`` turns a text's bytes into sample frames and multiplexes them as
two logical streams, the even and the odd frames, each opened by a header
packet. ``from_media`` reads the pages: checksums are verified, packets put
together from lacing values (over page ends too), streams told apart by
serial number, frames merged by their granule positions, and times derived
from those.

Cases: null and empty texts are one frame of padding; equal texts give equal
bytes; a page with a wrong checksum, sequence or continuation raises; repeated
rows are stored apart; a very long text is many pages of one stream, held by
its task as one row; an empty table gives no rows; extra columns pass through
unless they carry a result's name.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from nomenclia.llm.common import python_ready, slices

FRAME = 576
PAD = b"\xff"
RATE = 8000
#: The capture pattern, the header flags and the largest lacing value.
CAPTURE, CONTINUED, FIRST, LAST, LACE = b"OggS", 1, 2, 4, 255
MAGIC = b"PCMU8\0\0\1"
SERIALS = (0x45564E00, 0x4F444400)

_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def page_crc(page: bytes) -> int:
    """CRC-32 of polynomial 0x04C11DB7, most significant bit first, from 0: the mirror image of zlib's."""
    mirrored = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_REVERSED), "big")


def page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = CAPTURE + struct.pack("<BBqII", 0, flags, granule, serial, number)
    rest = bytes([len(lacing)]) + lacing + body
    return head + struct.pack("<I", page_crc(head + b"\0\0\0\0" + rest)) + rest


def pages(packets: Iterable[tuple[bytes, int]], serial: int) -> list[tuple[int, bytes]]:
    """(granule, page) of a logical stream of (packet, granule at its end); the first packet has a page of its own."""
    packets = list(packets)
    out: list[tuple[int, bytes]] = []
    lacing, body, granule, flags = bytearray(), [], -1, FIRST

    def close(last: bool) -> None:
        nonlocal lacing, body, granule, flags
        out.append((granule, page(flags | (LAST if last else 0), granule, serial, len(out), bytes(lacing), b"".join(body))))
        lacing, body, granule, flags = bytearray(), [], -1, 0

    for k, (packet, end) in enumerate(packets):
        values = b"\xff" * (len(packet) // LACE) + bytes([len(packet) % LACE])
        at = 0
        while values:
            if len(lacing) == 255:
                close(False)
                flags = CONTINUED if at else 0
            fit, values = values[: 255 - len(lacing)], values[255 - len(lacing) :]
            size = sum(fit)
            lacing += fit
            body.append(packet[at : at + size])
            at += size
        granule = end
        if k == 0 or k == len(packets) - 1:
            close(k == len(packets) - 1)
    return out


def write_media(data: bytes) -> bytes:
    """An Ogg file of ``data`` padded to whole frames."""
    count = max(1, -(-len(data) // FRAME))
    payload = data + PAD * (count * FRAME - len(data))
    streams = []
    for which, serial in enumerate(SERIALS):
        header = MAGIC + struct.pack("<IHBBQ", RATE, FRAME, len(SERIALS), which, len(data))
        frames = [(payload[f * FRAME : (f + 1) * FRAME], (f + 1) * FRAME) for f in range(which, count, len(SERIALS))]
        streams.append(pages([(header, 0), *frames], serial))
    firsts = [s[0][1] for s in streams]
    rest = sorted((g, which, n, p) for which, s in enumerate(streams) for n, (g, p) in enumerate(s[1:]))
    return b"".join([*firsts, *(p for *_, p in rest)])


def read_pages(media: bytes) -> dict[int, list[tuple[bytes, int | None]]]:
    """serial -> packets with the granule position of the page on which they are the last to end, else None."""
    at, streams, open_packet, numbers = 0, {}, {}, {}
    while at < len(media):
        if media[at : at + 4] != CAPTURE:
            raise ValueError(f"no page at byte {at}")
        _, flags, granule, serial, number, crc, segments = struct.unpack_from("<BBqIIIB", media, at + 4)
        lacing = media[at + 27 : at + 27 + segments]
        end = at + 27 + segments + sum(lacing)
        if page_crc(media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : end]) != crc:
            raise ValueError(f"wrong checksum on the page at byte {at}")
        if number != numbers.get(serial, 0) or bool(flags & FIRST) != (serial not in streams) or bool(flags & CONTINUED) != (serial in open_packet):
            raise ValueError(f"page at byte {at} is out of place")
        numbers[serial] = number + 1
        packets = streams.setdefault(serial, [])
        part, cut, ended = open_packet.pop(serial, b""), at + 27 + segments, 0
        start = cut
        for value in lacing:
            cut += value
            if value < LACE:
                packets.append((part + media[start:cut], None))
                part, start, ended = b"", cut, ended + 1
        if start < cut or (lacing and lacing[-1] == LACE):
            open_packet[serial] = part + media[start:cut]
        if ended:
            packets[-1] = (packets[-1][0], granule)
        at = end
    if open_packet:
        raise ValueError("a packet does not end")
    return streams


def read_media(media: bytes) -> tuple[int, bytes, dict]:
    """(length without padding, payload, facts) of a file that ``write_media`` wrote."""
    frames: dict[int, bytes] = {}
    length, rate, last, streams = 0, RATE, 0, read_pages(media)
    for packets in streams.values():
        head = packets[0][0]
        if head[:8] != MAGIC:
            raise ValueError("unknown stream")
        rate, size, step, which, length = struct.unpack("<IHBBQ", head[8:])
        for k, (packet, granule) in enumerate(packets[1:]):
            end = (which + k * step + 1) * size
            if granule is not None and granule != end:
                raise ValueError("a granule position does not fit its packets")
            frames[end] = packet
            last = max(last, granule or 0)
    payload = b"".join(frames[k] for k in sorted(frames))
    if len(payload) != last:
        raise ValueError("frames are missing")
    return length, payload, {"rate": rate, "streams": len(streams), "packets": sum(map(len, streams.values())), "samples": last, "ms": last * 1000 // rate}


def to_media(docs: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """``docs`` with ``text`` stored as Ogg in the binary column ``media``."""
    keep = [c for c in docs.columns if c not in (text, media)]
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField(media, T.BinaryType())])
    arrow = to_arrow_schema(schema)

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            files = [write_media((t or "").encode()) for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).cast(arrow.field(c).type) for c in keep), pa.array(files, arrow.field(media).type)], schema=arrow)

    python_ready(docs.sparkSession)
    return docs.select(*keep, text).mapInArrow(stored, schema)


FEATURES = [("n_bytes", T.LongType()), ("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType())]


def from_media(files: DataFrame, media: str = "media") -> DataFrame:
    """``files`` without ``media`` but with what reading it gives: sizes, digests and sound features."""
    keep = [c for c in files.columns if c != media and c not in dict(FEATURES)]
    schema = T.StructType([*[files.schema[c] for c in keep], *[T.StructField(n, t) for n, t in FEATURES]])
    arrow = to_arrow_schema(schema)

    def features(data: bytes) -> tuple:
        length, payload, facts = read_media(data)
        samples = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
        crossings = int(np.count_nonzero((samples[1:] < 0) != (samples[:-1] < 0)))
        facts |= {"mean": f"{int(samples.sum()) / len(samples):.6f}", "power": f"{int((samples * samples).sum()) / len(samples):.6f}", "crossings": crossings}
        return length, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), ";".join(f"{k}={v}" for k, v in facts.items())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = list(zip(*(features(x.as_py()) for x in batch.column(media)), strict=True)) or [()] * len(FEATURES)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).cast(arrow.field(c).type) for c in keep), *(pa.array(r, arrow.field(n).type) for r, (n, _) in zip(rows, FEATURES, strict=True))], schema=arrow)

    python_ready(files.sparkSession)
    return files.select(*keep, media).mapInArrow(read, schema)
