"""Network captures (pcap and pcapng) as packet rows, decoded with the standard library alone.

Ethernet, Linux cooked and raw IP frames with IPv4; TCP and UDP payloads as hexadecimal bytes. SCTP chunks and
PFCP elements are decoded as trees (:mod:`layers`), fragments are put together (:mod:`capture`).
"""

from __future__ import annotations

import io
import json
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import BinaryIO

from pyspark.sql import DataFrame, SparkSession

from fathomweave.runtime import ship
from fathomweave.sources import layers

SCHEMA = (
    "file string, num string, src string, dst string, transport_layer string, length int, src_port string, dst_port string, "
    "has_tcp boolean, has_udp boolean, has_pfcp boolean, has_ngap boolean, has_sctp boolean, hex_payload string, layer_json string"
)
PFCP_PORT, NGAP_PROTOCOL = 8805, 60


def _start(head: bytes) -> tuple[str, list[int], int] | None:
    """Byte order, link types and first place of a pcap file; None for others."""
    if head[:4] in (b"\xd4\xc3\xb2\xa1", b"\xa1\xb2\xc3\xd4", b"\x4d\x3c\xb2\xa1", b"\xa1\xb2\x3c\x4d"):
        end = "<" if head[0] in (0xD4, 0x4D) else ">"
        return end, [struct.unpack(end + "I", head[20:24])[0]], 24
    return None


@dataclass
class Place:
    """Where reading may begin: offset, number of packets before, and what earlier blocks said."""

    at: int = 0
    number: int = 0
    end: str = "<"
    links: list[int] = field(default_factory=list)
    plain: bool = False


def blocks(stream: BinaryIO, place: Place, until: int, bodies: bool = True) -> Iterator[tuple[Place, int, bytes, int]]:
    """(place after it, link type, captured bytes, length on the wire) of each packet that starts before ``until``.

    Only headers are read where ``bodies`` is false. A block that is cut off ends the walk.
    """
    at, number, end, links, plain = place.at, place.number, place.end, list(place.links), place.plain
    if at == 0:
        stream.seek(0)
        first = _start(stream.read(24))
        if first is not None:
            end, links, at = first
            plain = True
    size_of = stream.seek(0, 2)
    while at < until:
        stream.seek(at)
        if plain:
            head = stream.read(16)
            if len(head) < 16:
                return
            kept, wire = struct.unpack(end + "II", head[8:16])
            if at + 16 + kept > size_of:
                return
            at, number = at + 16 + kept, number + 1
            yield Place(at, number, end, links, True), links[0], stream.read(kept) if bodies else b"", wire
            continue
        head = stream.read(12)
        if len(head) < 12:
            return
        if head[:4] == b"\x0a\x0d\x0d\x0a":
            end, links = ("<" if head[8:12] == b"\x4d\x3c\x2b\x1a" else ">"), []
        kind, size = struct.unpack(end + "II", head[:8])
        if size < 12 or at + size > size_of:
            return
        if kind in (1, 3, 6):
            body = head[8:] + stream.read(16 if not bodies or kind == 1 else size - 16)
            if kind == 1:
                links = [*links, struct.unpack(end + "H", body[:2])[0]]
            elif kind == 6:
                which, _, _, kept, wire = struct.unpack(end + "IIIII", body[:20])
                number += 1
                yield Place(at + size, number, end, links), links[which], body[20 : 20 + kept], wire
            else:
                wire = struct.unpack(end + "I", body[:4])[0]
                number += 1
                yield Place(at + size, number, end, links), links[0], body[4 : 4 + min(wire, size - 16)], wire
        at += size


def cuts(stream: BinaryIO, size: int, place: Place | None = None) -> Iterator[tuple[Place, int]]:
    """(place, end): parts of a capture of about ``size`` bytes that start and end between blocks, found by reading headers alone."""
    begin = place or Place()
    last = begin
    until = stream.seek(0, 2)
    for after, *_ in blocks(stream, begin, until, bodies=False):
        last = after
        if last.at - begin.at >= size:
            yield begin, last.at
            begin = last
    if last.at > begin.at:
        yield begin, last.at


def frames(data: bytes) -> Iterator[tuple[int, bytes, int]]:
    """(link type, captured bytes, length on the wire) of each packet of a capture file."""
    for _, link, frame, wire in blocks(io.BytesIO(data), Place(), len(data)):
        yield link, frame, wire


def datagram(link: int, frame: bytes) -> bytes | None:
    """The IPv4 datagram of a frame, without what follows it; None for others."""
    four = b"\x08\x00"
    if link == 1 and frame[12:14] == four:
        ip = frame[14:]
    elif link == 1 and frame[12:14] == b"\x81\x00" and frame[16:18] == four:
        ip = frame[18:]
    elif link == 113 and frame[14:16] == four:
        ip = frame[16:]
    else:
        ip = frame if link in (12, 101, 228) else b""
    if len(ip) < 20 or ip[0] >> 4 != 4:
        return None
    return ip[: struct.unpack(">H", ip[2:4])[0] or len(ip)]


def fragment(ip: bytes) -> tuple[int, int, bool] | None:
    """(identification, offset in octets, more follow) of a fragment; None for a whole datagram."""
    ident, flags = struct.unpack(">HH", ip[4:8])
    offset, more = (flags & 0x1FFF) * 8, bool(flags & 0x2000)
    return (ident, offset, more) if offset or more else None


def addresses(ip: bytes) -> tuple[str, str]:
    return ".".join(map(str, ip[12:16])), ".".join(map(str, ip[16:20]))


def row_of(src: str, dst: str, protocol: int, inner: bytes, size: int) -> dict:
    """The row of a whole datagram's payload."""
    row = {"src": src, "dst": dst, "length": size, "src_port": None, "dst_port": None, "transport_layer": {6: "TCP", 17: "UDP", 132: "SCTP"}.get(protocol)}
    row |= {k: False for k in ("has_tcp", "has_udp", "has_pfcp", "has_ngap", "has_sctp")} | {"hex_payload": None, "layer_json": None}
    if protocol in (6, 17, 132) and len(inner) >= 4:
        row["src_port"], row["dst_port"] = map(str, struct.unpack(">HH", inner[:4]))
    if protocol in (6, 17):
        body = inner[(inner[12] >> 4) * 4 :] if protocol == 6 and len(inner) > 12 else inner[8:]
        if protocol == 17 and str(PFCP_PORT) in (row["src_port"], row["dst_port"]) and len(body) >= 4:
            row["has_pfcp"], row["layer_json"] = True, json.dumps(layers.pfcp(body))
        elif body:
            row["has_tcp" if protocol == 6 else "has_udp"], row["hex_payload"] = True, layers.shown(body)
    elif protocol == 132 and len(inner) >= 12:
        decoded = layers.sctp(inner)
        row["has_ngap"], row["has_sctp"] = any(c.get("protocol") == str(NGAP_PROTOCOL) for c in decoded["chunks"]), True
        row["layer_json"] = json.dumps(decoded)
    return row


def decode(link: int, frame: bytes, size: int) -> dict | None:
    """The row of an IPv4 packet that is no fragment; None for others."""
    ip = datagram(link, frame)
    if ip is None or fragment(ip) is not None:
        return None
    return row_of(*addresses(ip), ip[9], ip[(ip[0] & 15) * 4 :], size)


def read_captures(spark: SparkSession, path: str, pattern: str = "*.pcap*", partition_bytes: int = 64 << 20) -> DataFrame:
    """A row for each IPv4 packet of the capture files of a folder, fragments put together.

    Files are cut between blocks into parts of about ``partition_bytes``, each read by one task. A datagram of fragments has the number
    and length of the fragment that completed it; what is never complete gives no row. The cuts are found by
    a job of its own, a task a file; fragments are gathered in a second pass over the files.
    """
    from fathomweave.sources import capture

    ship(spark)
    spark.dataSource.register(capture.CaptureSource)
    pushed = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false").lower()
    cuts_at = capture.index(spark, path, pattern, partition_bytes)
    read = lambda what: spark.read.format("captures").options(index=cuts_at, rows=what, pushFilters=pushed).load(path)
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return read("whole").select(*names).unionByName(capture.put_together(read("fragments")).select(*names))
