"""Decoded packets: layer dispatch, payload text, embedded JSON, projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dispatch(has_tcp: Column, has_udp: Column, has_pfcp: Column, has_ngap: Column, has_sctp: Column) -> Column:
    """The layer that is taken: the first with something in it; null: the packet is skipped."""
    return F.when(has_tcp, "tcp").when(has_udp, "udp").when(has_pfcp, "pfcp").when(has_ngap, "ngap").when(has_sctp, "sctp")


def transport(layer: Column, named: Column) -> Column:
    return F.coalesce(named, F.when(layer == "ngap", "sctp").otherwise(layer))


def printable(hex_payload: str) -> Column:
    """Bytes as aa:bb:… to text; what isn't printable ASCII is a dot."""
    return F.expr(f"array_join(transform(split({hex_payload}, ':'), x -> if(cast(conv(x, 16, 10) as int) between 32 and 126, chr(cast(conv(x, 16, 10) as int)), '.')), '')")


def embedded_json(c: str) -> Column:
    """The JSON text in a payload: from a bracket that comes first to the first closing bracket, else from the first brace to the last one; null if it isn't JSON."""
    bracket, brace = F.locate("[", F.col(c)), F.locate("{", F.col(c))
    last = F.length(c) - F.locate("}", F.reverse(c)) + 1
    array_first = (bracket > 0) & ((brace == 0) | (bracket < brace))
    found = F.when(array_first, F.substring(F.col(c), bracket, F.locate("]", F.col(c)) - bracket + 1)).when((brace > 0) & F.col(c).contains("}"), F.substring(F.col(c), brace, last - brace + 1))
    return F.when(F.try_parse_json(found).isNotNull(), found)


def project(packets: DataFrame) -> DataFrame:
    """The stored columns of the packets that carry JSON or a decoded layer; the rest is dropped."""
    rows = packets.withColumn("layer", dispatch(*[F.coalesce(F.col(x), F.lit(False)) for x in ("has_tcp", "has_udp", "has_pfcp", "has_ngap", "has_sctp")])).where("layer is not null")
    text = F.when(F.col("layer").isin("tcp", "udp"), printable("hex_payload"))
    rows = rows.withColumn("_text", text).withColumn("payload", F.when(F.col("layer").isin("tcp", "udp"), embedded_json("_text")).otherwise(F.col("layer_json"))).where("payload is not null")
    return rows.select("num", "src", "dst", transport(F.col("layer"), F.col("transport_layer")).alias("protocol"), "length", "src_port", "dst_port", "payload")


def as_variant(packets: DataFrame) -> DataFrame:
    return packets.withColumn("payload", F.try_parse_json("payload"))
