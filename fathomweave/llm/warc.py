"""Operator 13: WARC archives with a two-level capture index.

Archives: each task writes its records, one gzip member each, to a file of its own in the shared folder; names are never
used twice, and only what committed tasks report enters the index, so a task that is run again leaves at most a file that
nothing refers to. Of captures with equal payloads one is a response, the others are revisits without payload.

Index: entries sorted by key (host reversed, then path) in ranges; each range is a file of gzip blocks of BLOCK entries, and a
sparse directory keeps the first key, place and length of every block. A look-up finds its range among the ranges' first
keys (one for each range; all that is handed out whole), its block by binary search in that range's part of the directory,
the entry by binary search in the block, and then reads the record's bytes from its archive. Keys that are looked up
are sorted within tasks, so a block is opened once for all of its keys, and records are read in the order of their place.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import re
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomweave.runtime import new_path, ship, shuffle_partitions, write_table

#: Payloads below this are kept with every capture.
LEAST_BYTES = 100
#: Entries in a block of the index, and bytes of an archive after which the next one begins.
BLOCK, ARCHIVE_BYTES = 1000, 1 << 30
LEVEL = 6
#: No clock enters the records.
DATE = "1970-01-01T00:00:00Z"
ENTRY = "key string, id string, file string, start bigint, length bigint"
DIRECTORY = "part int, block int, first string, last string, file string, start bigint, length bigint"
CAPTURE = "id string, page_id bigint, type string, payload_bytes bigint, payload_digest string, refers_uri string, refers_id string"


def filesystem(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The store that ``path`` names (file, hdfs, s3, ...; without a scheme: local) and the path in it."""
    return pyarrow.fs.FileSystem.from_uri(re.sub("^(file:)?/+", "file:///", path))


def _header(value: str) -> str:
    """``value`` on one line, so that any URL can be a header; what was changed once is not changed again."""
    return re.sub(r"[%\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value) if re.search(r"[\x00-\x20\x7f]", value) else value


def surt(url: str | None) -> str:
    """The key of a URL: reversed host and port, then path and query; scheme, user and fragment don't count, nor letter case in the host. Null: empty."""
    url = _header(url or "")
    found = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(:\d+)?([^#]*)", url)
    if not found:
        return url.partition("#")[0]
    host, port, rest = found.groups()
    return f"{','.join(reversed(host.lower().split('.')))}{'' if port in (None, ':80', ':443') else port}){rest or '/'}"


def record_id(*of: int | str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, json.dumps(of))}>"


def record(fields: dict[str, str], payload: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items())
    return f"WARC/1.1\r\n{head}Content-Length: {len(payload)}\r\n\r\n".encode() + payload + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Fields and payload of one record; what doesn't hold together stops the job."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines)
    size = int(fields["Content-Length"])
    if not version.startswith("WARC/1.") or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"not a whole record: {lines[:3]}")
    return fields, rest[:size]


def capture(row: dict, html: str | None, place: list) -> tuple[str, dict[str, str], bytes]:
    """Key, fields and payload of the record for a row of :func:`decided`; ``place`` tells small ones apart that are alike in all."""
    payload = (html or "").encode() if row["type"] == "response" else b""
    own = record_id(row["page_id"], row["url"], row["digest"], row["copy"], *(place if row["type"] == "response" and len(payload) < LEAST_BYTES else []))
    fields = {"WARC-Type": row["type"], "WARC-Record-ID": own, "WARC-Date": DATE, "WARC-Target-URI": _header(row["url"] or ""), "WARC-Payload-Digest": f"sha256:{row['digest']}", "Content-Type": "text/html"}
    if row["page_id"] is not None:
        fields["X-Page-ID"] = str(row["page_id"])
    if row["type"] == "revisit":
        first = row["first"]
        fields |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": record_id(first["page_id"], first["url"], row["digest"], 0), "WARC-Refers-To-Target-URI": _header(first["url"] or "")}
    return surt(row["url"]), fields, payload


def decided(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest, type, first (page_id, url of the response), copy: a row for each record.

    Of rows with equal payloads of LEAST_BYTES or more, the one with the smallest page_id (null last; ties: smallest url,
    null last; then any one of the equal rows) is the response. Only digests that occur more than once are looked up, and
    only responses carry their html on.
    """
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    place = F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", F.col("url").isNull().alias("no_url"), "url")
    same = rows.where(F.octet_length("html") >= LEAST_BYTES).groupBy("digest", "page_id", "url").agg(F.count("*").alias("n")).withColumn("place", place)
    often = same.groupBy("digest").agg(F.min(F.struct("place", "n")).alias("least"), F.sum("n").alias("all")).where(F.col("all") > 1)
    often, _ = write_table(often.select("digest", F.col("least.place").alias("first"), F.col("least.n").alias("first_n")), "repeated-payloads")
    known = rows.join(often, "digest", "left").withColumn("place", place)
    chosen = known.where("first is null or first = place and first_n = 1")
    if not often.where("first_n > 1").isEmpty():
        chosen = chosen.unionByName(known.where("first = place and first_n > 1").dropDuplicates(["digest"]))
    named = F.struct("first.page_id", "first.url")
    responses = chosen.select("page_id", "url", "html", "digest", F.lit("response").alias("type"), named.alias("first"), F.lit(0).cast("bigint").alias("copy"))
    # the copies of rows that are alike in all are numbered; copy 0 of the first place is the response
    copies = F.explode(F.sequence(F.when(F.col("first") == F.col("place"), 1).otherwise(0).cast("bigint"), F.col("n") - 1)).alias("copy")
    again = same.join(often, "digest").where("first <> place or n > 1").select("page_id", "url", F.lit(None).cast("string").alias("html"), "digest", F.lit("revisit").alias("type"), named.alias("first"), copies)
    return responses.unionByName(again)


def _archived(folder: str, schema: pa.Schema, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, store, path, at = None, None, "", 0
        store, base = filesystem(folder)
        for batch in batches:
            entries = []
            html = batch.column("html")
            for i, row in enumerate(batch.drop_columns(["html"]).to_pylist()):
                if out is None or at >= most:
                    if out is not None:
                        out.close()
                    path, at = f"part-{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{base}/{path}", compression=None)
                    info = gzip.compress(record({"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": DATE, "WARC-Filename": path, "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n"), LEVEL, mtime=0)
                    out.write(info)
                    at = len(info)
                key, fields, payload = capture(row, html[i].as_py(), [path, at])
                member = gzip.compress(record(fields, payload), LEVEL, mtime=0)
                out.write(member)
                entries.append({"key": key, "id": fields["WARC-Record-ID"], "file": path, "start": at, "length": len(member)})
                at += len(member)
            yield pa.RecordBatch.from_pylist(entries, schema)
        if out is not None:
            out.close()

    return run


def _blocks(folder: str, schema: pa.Schema, size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Writes sorted entries of one range as gzip blocks; a row of the directory for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = filesystem(folder)
        path, out, at, held, part = f"range-{uuid.uuid4().hex}.cdx.gz", None, 0, [], 0
        rows = []

        def put() -> None:
            nonlocal at, out
            if out is None:
                out = store.open_output_stream(f"{base}/{path}", compression=None)
            block = gzip.compress("\n".join(json.dumps([r[c] for c in ("key", "id", "file", "start", "length")], ensure_ascii=False) for r in held).encode(), LEVEL, mtime=0)
            out.write(block)
            rows.append({"part": part, "block": len(rows), "first": held[0]["key"], "last": held[-1]["key"], "file": path, "start": at, "length": len(block)})
            at += len(block)
            held.clear()

        for batch in batches:
            for row in batch.to_pylist():
                part = row["part"]
                held.append(row)
                if len(held) == size:
                    put()
        if held:
            put()
        if out is not None:
            out.close()
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl))


def _made(folder: str) -> None:
    store, base = filesystem(folder)
    store.create_dir(base, recursive=True)


def write_archive(pages: DataFrame, root: str, block: int = BLOCK, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) as archives with their index under ``root``; returns its directory.

    Null html is an empty payload, a null url an empty target; repeated rows are records of their own; other columns
    are ignored; no pages give no archives and an empty directory.
    """
    spark = pages.sparkSession
    ship(spark)
    for folder in (f"{root}/archive", f"{root}/index"):
        _made(folder)
    entries, _ = write_table(decided(pages).mapInArrow(_archived(f"{root}/archive", _arrow(ENTRY), archive_bytes), ENTRY), "captures")
    ordered = entries.repartitionByRange(shuffle_partitions(spark), "key", "id").sortWithinPartitions("key", "id").withColumn("part", F.spark_partition_id())
    ordered.mapInArrow(_blocks(f"{root}/index", _arrow(DIRECTORY), block), DIRECTORY).write.parquet(f"{root}/directory")
    return directory(spark, root)


def directory(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(DIRECTORY).parquet(f"{root}/directory")


class Index:
    """One range of the index: binary search in its part of the directory, then in the block."""

    def __init__(self, root: str, rows: list[dict]) -> None:
        self.rows = sorted(rows, key=lambda r: r["block"])
        self.lasts = [r["last"].encode() for r in self.rows]
        self.store, self.base = filesystem(root)
        self.opened, self.keys, self.entries = -1, [], []

    def read(self, folder: str, file: str, start: int, length: int) -> bytes:
        with self.store.open_input_file(f"{self.base}/{folder}/{file}") as f:
            return gzip.decompress(f.read_at(length, start))

    def block(self, k: int) -> None:
        if self.opened != k:
            r = self.rows[k]
            self.entries = [json.loads(x) for x in self.read("index", r["file"], r["start"], r["length"]).decode().split("\n")]
            self.keys = [x[0].encode() for x in self.entries]
            self.opened = k

    def find(self, key: str) -> Iterator[list]:
        """All entries of ``key``, over as many blocks as they fill. Keys compare by their bytes, as they are sorted."""
        wanted = key.encode()
        k = bisect.bisect_left(self.lasts, wanted)
        while k < len(self.rows) and self.rows[k]["first"].encode() <= wanted:
            self.block(k)
            i = bisect.bisect_left(self.keys, wanted)
            while i < len(self.keys) and self.keys[i] == wanted:
                yield self.entries[i]
                i += 1
            k += 1


def _searched(root: str, schema: pa.Schema, at_once: int = 4096) -> Callable[[tuple, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Captures of the keys asked for. Rows are the range's part of the directory, then sorted keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, index, part, found, last = [], None, None, [], None

        def captures() -> pa.RecordBatch:
            out = []
            found.sort(key=lambda e: (e[2], e[3]))
            name, f = None, None
            for _, own, file, start, length in found:
                if file != name:
                    if f is not None:
                        f.close()
                    name, f = file, index.store.open_input_file(f"{index.base}/archive/{file}")
                fields, payload = parsed(gzip.decompress(f.read_at(length, start)))
                if fields["WARC-Record-ID"] != own:
                    raise ValueError(f"{file} has another record at {start} than the index says")
                page = fields.get("X-Page-ID")
                known = {"id": own, "page_id": None if page is None else int(page), "type": fields["WARC-Type"], "refers_uri": fields.get("WARC-Refers-To-Target-URI"), "refers_id": fields.get("WARC-Refers-To")}
                if fields["WARC-Type"] == "response":
                    known |= {"payload_bytes": len(payload), "payload_digest": hashlib.sha256(payload).hexdigest()}
                    if fields["WARC-Payload-Digest"] != f"sha256:{known['payload_digest']}":
                        raise ValueError(f"the payload of {own} is not what its digest says")
                out.append(known)
            if f is not None:
                f.close()
            found.clear()
            return pa.RecordBatch.from_pylist(out, schema)

        for batch in batches:
            for row in batch.to_pylist():
                if row["part"] != part:
                    if found:
                        yield captures()
                    rows, index, part, last = [], None, row["part"], None
                if row["key"] is None:
                    rows.append(row)
                    continue
                if index is None:
                    index = Index(root, rows)
                if row["key"] == last:
                    continue
                last = row["key"]
                for entry in index.find(last):
                    found.append(entry)
                    if len(found) >= at_once:
                        yield captures()
        if found:
            yield captures()

    return run


def look_up(keys: DataFrame, root: str) -> DataFrame:
    """id, page_id, type, payload_bytes, payload_digest, refers_uri, refers_id of all captures of ``keys`` (key), each once.

    The directory travels to the tasks by range, with the keys; only the ranges' first and last keys, one row a range, go to all.
    """
    spark = keys.sparkSession
    ship(spark)
    table = directory(spark, root)
    bounds = table.groupBy("part").agg(F.min("first").alias("first"), F.max("last").alias("last")).orderBy("part").collect()
    if not bounds:
        return spark.createDataFrame([], CAPTURE)
    wanted = keys.select("key").where("key is not null").distinct()
    parts = [(r["part"], r["first"].encode(), r["last"].encode()) for r in bounds]

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lasts = [x[2] for x in parts]
        for batch in batches:
            out = []
            for key in batch.column(0).to_pylist():
                wanted = key.encode()
                k = bisect.bisect_left(lasts, wanted)
                # a key with very many captures can fill the end of one range and more
                while k < len(parts) and parts[k][1] <= wanted:
                    out.append((parts[k][0], key))
                    k += 1
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.string())], names=["part", "key"])

    asked = wanted.mapInArrow(ranges, "part int, key string")
    empty = [F.lit(None).cast(t).alias(c) for c, t in (("block", "int"), ("first", "string"), ("last", "string"), ("file", "string"), ("start", "bigint"), ("length", "bigint"))]
    both = table.select("part", F.lit(None).cast("string").alias("key"), "block", "first", "last", "file", "start", "length").unionByName(asked.select("part", "key", *empty))
    dealt = both.repartition(max(len(parts), 1), "part").sortWithinPartitions("part", F.col("key").asc_nulls_first(), "block")
    return dealt.mapInArrow(_searched(root, _arrow(CAPTURE)), CAPTURE)


def surts(rows: DataFrame, url: str) -> DataFrame:
    """key: that of every ``url`` of ``rows``."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([surt(u) for u in batch.column(0).to_pylist()], pa.string())], names=["key"])

    return rows.select(F.col(url).cast("string").alias("url")).mapInArrow(run, "key string")


def read_captures(urls: DataFrame, root: str, url: str = "url") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of all captures of ``urls``, read from the archives alone.

    A revisit's payload is that of the response that it names, which is looked up in the same index.
    """
    spark = urls.sparkSession
    found, _ = write_table(look_up(surts(urls, url), root), "looked-up")
    again = found.where("type = 'revisit'")
    named, _ = write_table(look_up(surts(again.select("refers_uri").distinct(), "refers_uri"), root).where("type = 'response'"), "referred-to")
    of = named.select(F.col("id").alias("refers_id"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("b"), F.col("payload_digest").alias("d"))
    fault = F.raise_error(F.concat(F.lit("no response for the revisit "), F.col("id")))
    met = again.join(of, "refers_id", "left").withColumn("b", F.when(F.col("b").isNotNull(), F.col("b")).otherwise(fault.cast("bigint")))
    own = found.where("type <> 'revisit'").select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.lit(None).cast("bigint").alias("refers_to"))
    return own.unionByName(met.select("page_id", F.col("b").alias("payload_bytes"), F.col("d").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page is written, then looked up by its URL."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    root = new_path(spark, "warc")
    write_archive(pages, root)
    return read_captures(pages, root)


OP13_SQL = f"""
with told as (select page_id, encode(coalesce(html, '')) as payload from pages),
hashed as (select page_id, octet_length(payload) as payload_bytes, sha256(payload) as payload_digest from told),
first as (select payload_digest, min(page_id) as least from hashed where payload_bytes >= {LEAST_BYTES} group by 1)
select page_id, payload_bytes, h.payload_digest, case when least <> page_id then 'revisit' else 'response' end as record_type, case when least <> page_id then least end as refers_to
from hashed h left join first f on f.payload_digest = h.payload_digest
"""
