"""Files: machines as JSON and DOT, packets as JSON, parsed paragraphs, samples."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomweave.functions import text as tx
from fathomweave.runtime import filesystem, ship, write_table


def write_machines(documents: DataFrame, column: str, folder: str, suffix: str = "json", tail: str = "") -> DataFrame:
    """One file ``{name}{tail}.{suffix}`` a procedure, by its sanitised name; returns (procedure, file) of what was written.

    ``documents``: procedure and the JSON or DOT column. JSON is indented by two. Files are written by the tasks, each under a name of its own
    first, so a task that is run again leaves whole files. Procedures whose names become one share a file; the least of them has it.
    """
    spark = documents.sparkSession
    ship(spark)
    named = documents.select("procedure", F.concat(tx.file_name(F.col("procedure")), F.lit(f"{tail}.{suffix}")).alias("file"), F.col(column).alias("value"))
    own = named.groupBy("file").agg(F.min(F.struct("procedure", "value")).alias("x")).select("x.procedure", "file", "x.value")
    store, base = filesystem(folder)
    store.create_dir(base, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = filesystem(folder)
        for batch in batches:
            for row in batch.to_pylist():
                text = json.dumps(json.loads(row["value"]), indent=2, ensure_ascii=False) if suffix == "json" else row["value"]
                draft = f"{base}/.{row['file']}-{uuid.uuid4().hex}"
                with store.open_output_stream(draft, compression=None) as f:
                    f.write(text.encode())
                store.move(draft, f"{base}/{row['file']}")
            yield batch.select(["procedure", "file"])

    done, _ = write_table(own.where("value is not null").mapInArrow(run, "procedure string, file string"), "machine-files")
    return done


def write_packets(packets: DataFrame, folder: str) -> None:
    """JSON lines, in parallel."""
    packets.write.mode("overwrite").json(folder)


def packet_envelope(packets: DataFrame) -> DataFrame:
    """One row with {"packets": [...]} in packet order, for captures that fit a single document."""
    rows = packets.agg(F.array_sort(F.collect_list(F.struct(F.col("num").try_cast("bigint").alias("n"), F.struct(*packets.columns).alias("p")))).alias("ps"))
    return rows.select(F.to_json(F.struct(F.transform("ps", lambda x: x["p"]).alias("packets"))).alias("json"))


def preview(packets: DataFrame, n: int = 2) -> DataFrame:
    return packets.orderBy(F.col("num").try_cast("bigint")).limit(n)


def sample_relations(edges: DataFrame, kind: str, n: int = 5) -> DataFrame:
    return edges.where(F.col("rel_type") == kind).orderBy("source_name", "target_name").limit(n)


def paragraph_log(paragraphs: DataFrame) -> DataFrame:
    """document, para_seq, is_header, style, text: how each paragraph was read."""
    return paragraphs.select("document", "para_seq", tx.is_header(F.col("style"), F.col("text")).alias("is_header"), "style", "text")
