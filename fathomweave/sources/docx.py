"""Word documents as paragraphs, decoded with the standard library alone."""

from __future__ import annotations

import io
import xml.etree.ElementTree as ET
import zipfile

from pyspark.sql import DataFrame, SparkSession

from fathomweave.runtime import ship

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SCHEMA = "document string, doc_seq int, para_seq int, style string, text string, error string"


def paragraphs(content: bytes) -> list[tuple[str, str]]:
    """(style name, text) of each paragraph of the body, in order; tabs and breaks are kept."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ET.fromstring(z.read("word/document.xml"))
        names = {}
        if "word/styles.xml" in z.namelist():
            for s in ET.fromstring(z.read("word/styles.xml")).iter(f"{W}style"):
                label = s.find(f"{W}name")
                names[s.get(f"{W}styleId")] = label.get(f"{W}val") if label is not None else s.get(f"{W}styleId")
    out = []
    for p in body.iter(f"{W}p"):
        style = p.find(f"{W}pPr/{W}pStyle")
        key = style.get(f"{W}val") if style is not None else "Normal"
        text = "".join(x.text or "" if x.tag == f"{W}t" else "\t" if x.tag == f"{W}tab" else "\n" if x.tag in (f"{W}br", f"{W}cr") else "" for x in p.iter())
        name = names.get(key, key)
        out.append((name[:1].upper() + name[1:] if name else "Normal", text.strip()))
    return out


def stem(file: str) -> str:
    return file.rpartition("/")[2].removesuffix(".docx")


def read_documents(spark: SparkSession, folder: str, pattern: str = "*_new.docx") -> DataFrame:
    """A row for each paragraph of the files of one folder; a file that can't be read gives one row with its error.

    doc_seq numbers the files by name, which the order of sections follows.
    """
    from fathomweave.sources import capture

    ship(spark)
    spark.dataSource.register(capture.ParagraphSource)
    return spark.read.format("paragraphs").option("pattern", pattern).load(folder)
