"""Captures and Word documents as Python data sources: ``spark.read.format("captures")``, ``readStream``, ``format("paragraphs")``.

A walk over the block headers of captures finds places between blocks (:func:`index` does so in tasks, a file each), so that a large
file is read by several tasks and no file is ever one row. Files are opened through pyarrow, so a path can name any store it knows.
"""

from __future__ import annotations

import fnmatch
import json
import zipfile
from collections.abc import Iterator, Sequence
from dataclasses import asdict
from xml.etree.ElementTree import ParseError

import pyarrow as pa
import pyarrow.dataset
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, InputPartition
from pyspark.sql.types import StructType, _parse_datatype_string

from fathomweave.runtime import filesystem, ship, write_table
from fathomweave.sources import docx, pcap

FRAGMENT = "protocol int, frag_id int, frag_offset int, frag_more boolean, frag_bytes binary"
SCHEMA = f"{pcap.SCHEMA}, {FRAGMENT}"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
#: Columns whose equality is tested before a packet is decoded.
PUSHED = ("src", "dst", "file")


def listed(path: str, pattern: str) -> list[tuple[str, int]]:
    """(path, size) of the files of a folder whose name fits, by name; or of the one file that ``path`` is."""
    store, base = filesystem(path)
    info = store.get_file_info(base)
    found = [info] if info.type == pyarrow.fs.FileType.File else store.get_file_info(pyarrow.fs.FileSelector(base)) if info.type == pyarrow.fs.FileType.Directory else []
    scheme = path[: path.index("://") + 3] if "://" in path and not path.startswith("file:") else "file:"
    return sorted((scheme + f.path, f.size) for f in found if f.type == pyarrow.fs.FileType.File and fnmatch.fnmatch(f.base_name, pattern))


class Part(InputPartition):
    def __init__(self, file: str, place: dict, end: int) -> None:
        self.file, self.place, self.end = file, place, end


def _opened(file: str):
    store, base = filesystem(file)
    return store.open_input_file(base)


def _parts(file: str, size: int, place: pcap.Place | None = None) -> list[Part]:
    with _opened(file) as f:
        return [Part(file, asdict(p), end) for p, end in pcap.cuts(f, size, place)]


CUT = "file string, at bigint, number bigint, byte_order string, links array<int>, plain boolean, end bigint"


def index(spark: SparkSession, path: str, pattern: str = "*.pcap*", partition_bytes: int = 64 << 20) -> str:
    """Walks the headers of all captures of a folder, a task for each file, and writes where they may be cut; the table's path is the reader's option ``index``."""
    ship(spark)
    files = listed(path, pattern)
    schema = _arrow(_parse_datatype_string(CUT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                with _opened(file) as f:
                    for p, end in pcap.cuts(f, partition_bytes):
                        yield pa.RecordBatch.from_pylist([{"file": file, "at": p.at, "number": p.number, "byte_order": p.end, "links": p.links, "plain": p.plain, "end": end}], schema)

    names = spark.createDataFrame([(f,) for f, _ in files], "file string").repartition(max(1, len(files)))
    return write_table(names.mapInArrow(run, CUT), "capture-cuts")[1]


def _indexed(path: str) -> list[Part]:
    store, base = filesystem(path)
    rows = pyarrow.dataset.dataset(base, format="parquet", filesystem=store, exclude_invalid_files=True).to_table().to_pylist()
    parts = [Part(r["file"], {"at": r["at"], "number": r["number"], "end": r["byte_order"], "links": r["links"], "plain": r["plain"]}, r["end"]) for r in rows]
    return sorted(parts, key=lambda p: (p.file, p.place["at"]))


def _rows(part: Part, what: str, wanted: dict[str, set]) -> Iterator[dict]:
    """Rows of a part; packets that ``wanted`` rules out are not decoded."""
    if "file" in wanted and part.file not in wanted["file"]:
        return
    with _opened(part.file) as f:
        for after, link, frame, size in pcap.blocks(f, pcap.Place(**part.place), part.end):
            ip = pcap.datagram(link, frame)
            if ip is None:
                continue
            src, dst = pcap.addresses(ip)
            if src not in wanted.get("src", {src}) or dst not in wanted.get("dst", {dst}):
                continue
            cut, inner = pcap.fragment(ip), ip[(ip[0] & 15) * 4 :]
            base = {"file": part.file, "num": str(after.number), "protocol": ip[9]}
            if cut is None and what != "fragments":
                yield base | pcap.row_of(src, dst, ip[9], inner, size)
            elif cut is not None and what != "whole":
                yield base | {"src": src, "dst": dst, "length": size, "frag_id": cut[0], "frag_offset": cut[1], "frag_more": cut[2], "frag_bytes": inner}


def _arrow(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _batches(rows: Iterator[dict], schema: StructType, most: int = 2000) -> Iterator[pa.RecordBatch]:
    arrow, held = _arrow(schema), []
    for row in rows:
        held.append({c: row.get(c) for c in schema.names})
        if len(held) == most:
            yield pa.RecordBatch.from_pylist(held, arrow)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, arrow)


class CaptureSource(DataSource):
    """Packets of captures. Options: path, pattern, partitionBytes, rows (whole, fragments or all), pushFilters (true or false),
    index (what :func:`index` wrote; without it, planning walks the headers itself)."""

    @classmethod
    def name(cls) -> str:
        return "captures"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return (FilteredCaptureReader if self.options.get("pushFilters") == "true" else CaptureReader)(schema, self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return CaptureStream(schema, self.options)


class _Options:
    def __init__(self, schema: StructType, options: dict) -> None:
        self.schema, self.path = schema, options["path"]
        self.pattern, self.size, self.what = options.get("pattern", "*.pcap*"), int(options.get("partitionBytes", 64 << 20)), options.get("rows", "all")
        self.index = options.get("index")
        self.wanted: dict[str, set] = {}


class CaptureReader(_Options, DataSourceReader):
    def partitions(self) -> Sequence[InputPartition]:
        if self.index:
            return _indexed(self.index)
        return [p for file, _ in listed(self.path, self.pattern) for p in _parts(file, self.size)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return _batches(_rows(partition, self.what, self.wanted), self.schema)


class FilteredCaptureReader(CaptureReader):
    """Takes equality of src, dst and file; the rest is Spark's. Spark allows it only where ``spark.sql.python.filterPushdown.enabled`` is set."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute in [(c,) for c in PUSHED]:
                self.wanted[f.attribute[0]] = self.wanted.get(f.attribute[0], {f.value}) & {f.value}
            else:
                yield f


class CaptureStream(_Options, DataSourceStreamReader):
    """New captures, and what is added to those that grow. An offset names, for each file, the place after its last whole block."""

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        self.ends = getattr(self, "ends", {})
        for file, size in listed(self.path, self.pattern):
            known = self.ends.get(file)
            if known is not None and known["at"] == size:
                continue
            place = pcap.Place(**known) if known else pcap.Place()
            with _opened(file) as f:
                for after, *_ in pcap.blocks(f, place, size, bodies=False):
                    place = after
            if place.at:
                self.ends[file] = asdict(place)
        return json.loads(json.dumps(self.ends))

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        out = []
        for file, place in sorted(end.items()):
            before = start.get(file)
            if before is None or before["at"] < place["at"]:
                parts = [p for p in _parts(file, self.size, pcap.Place(**before) if before else None) if p.place["at"] < place["at"]]
                # what was added since the offset was taken belongs to the next batch
                for p in parts:
                    p.end = min(p.end, place["at"])
                out += parts
        return out

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return _batches(_rows(partition, self.what, {}), self.schema)


def put_together(fragments: DataFrame) -> DataFrame:
    """The rows of the datagrams whose fragments (rows of the source) are all there, whatever their order.

    Fragments belong together by file, addresses, protocol and identification. An identification is used again once its datagram
    is complete; a first fragment that comes again before that replaces what was there.
    """
    names = [x.split()[0] for x in pcap.SCHEMA.split(", ")]
    keys = ["file", "src", "dst", "protocol", "frag_id"]
    schema = _arrow(fragments.select(*names).schema)

    def run(table: pa.Table) -> pa.Table:
        rows, held, out = sorted(table.to_pylist(), key=lambda r: int(r["num"])), {}, []
        for r in rows:
            held[r["frag_offset"]] = r
            at, parts = 0, []
            while at in held:
                part = held[at]
                parts.append(part["frag_bytes"])
                at += len(part["frag_bytes"])
                if not part["frag_more"]:
                    made = pcap.row_of(r["src"], r["dst"], r["protocol"], b"".join(parts), r["length"])
                    out.append({"file": r["file"], "num": r["num"]} | made)
                    held = {}
                    break
                if not part["frag_bytes"]:
                    break
        return pa.Table.from_pylist([{c: o.get(c) for c in names} for o in out], schema)

    return fragments.where(F.col("frag_id").isNotNull()).groupBy(*keys).applyInArrow(run, fragments.select(*names).schema)


class Documents(InputPartition):
    def __init__(self, files: list[tuple[str, int]]) -> None:
        self.files = files


class ParagraphSource(DataSource):
    """Paragraphs of Word documents. Options: path, pattern, partitionBytes. doc_seq numbers the files by name, as they are listed."""

    @classmethod
    def name(cls) -> str:
        return "paragraphs"

    def schema(self) -> str:
        return docx.SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return ParagraphReader(schema, self.options)


class ParagraphReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.schema, self.path = schema, options["path"]
        self.pattern, self.size = options.get("pattern", "*_new.docx"), int(options.get("partitionBytes", 32 << 20))

    def partitions(self) -> Sequence[InputPartition]:
        out, held, size = [], [], 0
        for i, (file, own) in enumerate(sorted(listed(self.path, self.pattern), key=lambda x: docx.stem(x[0]))):
            held.append((file, i))
            size += own
            if size >= self.size:
                out.append(Documents(held))
                held, size = [], 0
        return out + ([Documents(held)] if held or not out else [])

    def read(self, partition: Documents) -> Iterator[tuple]:
        for file, seq in partition.files:
            name = docx.stem(file)
            with _opened(file) as f:
                content = f.read()
            try:
                for i, (style, text) in enumerate(docx.paragraphs(content)):
                    yield name, seq, i, style, text, None
            except (zipfile.BadZipFile, KeyError, ParseError) as e:
                yield name, seq, None, None, None, f"{type(e).__name__}: {e}"
