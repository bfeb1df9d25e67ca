import gzip
import hashlib
import random
from pathlib import Path

import pytest

from fathomweave.llm import warc
from fathomweave.llm.warc import OP13_SQL, Index, directory, op13_warc, parsed, read_captures, surt, write_archive
from tests.llm.common import bag
from tests.oracle import SF, assert_same

COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
SCHEMA = "page_id bigint, url string, html string, key string, digest string, copy int, n bigint, first string"


def plain(rows):
    out, groups = [], {}
    for page_id, url, html in rows:
        data = (html or "").encode()
        groups.setdefault(data, []).append((page_id is None, page_id or 0, url is None, url or "", page_id))
    for data, of in groups.items():
        digest = hashlib.sha256(data).hexdigest()
        of.sort(key=lambda x: x[:4])
        for i, x in enumerate(of):
            again = len(data) >= 100 and i > 0
            out.append((x[4], len(data), digest, "revisit" if again else "response", of[0][4] if again else None))
    return sorted(out, key=repr)


def pages():
    r = random.Random(5)
    long = ["é" * 50, "a" * 99, "b" * 100, "<p>" * 400, "x" * 300000, "line\r\n\r\nline\n" * 20, "", None, "c" * 101]
    rows = [(i if i % 7 else None, r.choice(["http://A.example.com:80/x?q=%1#f", "https://b.example.org/y z\r\n", "//u@c.example/", None, "", "no url", "http://日本.example/ü", f"http://h{i}.example.com/{i}"]), r.choice(long)) for i in range(300)]
    return rows + rows[:9] + rows[:9] + [(3, "http://hot.example/", "<html>" * 30)] * 500


def written(spark, tmp_path, rows, **how):
    df = spark.createDataFrame([(*x, "k", "d", 1, 2, "f") for x in rows], SCHEMA)
    root = f"file://{tmp_path}/w"
    write_archive(df, root, **how)
    return df, root


def test_odd_rows(spark, tmp_path):
    rows = pages()
    df, root = written(spark, tmp_path, rows)
    assert bag(read_captures(df, root), *COLUMNS) == plain(rows)


def test_small_blocks_and_archives(spark, tmp_path):
    """Captures of one key over several blocks and ranges, and archives of a few records."""
    rows = pages()
    df, root = written(spark, tmp_path, rows, block=3, archive_bytes=2000)
    assert directory(spark, root).count() > 100
    assert bag(read_captures(df, root), *COLUMNS) == plain(rows)


def test_no_pages(spark, tmp_path):
    df, root = written(spark, tmp_path, [])
    assert read_captures(df, root).collect() == []


def test_archives_are_plain_warc(spark, tmp_path):
    rows = pages()
    written(spark, tmp_path, rows)
    kinds, ids = [], set()
    for f in Path(tmp_path, "w", "archive").glob("*.warc.gz"):
        data = gzip.decompress(f.read_bytes())
        while data:
            end = data.index(b"\r\n\r\n") + 4
            size = int(data[:end].split(b"Content-Length: ")[1].split(b"\r\n")[0])
            fields, payload = parsed(data[: end + size + 4])
            assert fields["WARC-Record-ID"] not in ids
            ids.add(fields["WARC-Record-ID"])
            kinds.append(fields["WARC-Type"])
            data = data[end + size + 4 :]
    want = [x[3] for x in plain(rows)]
    assert sorted(k for k in kinds if k != "warcinfo") == sorted(want)


def test_keys_that_are_not_there(spark, tmp_path):
    rows = pages()
    _, root = written(spark, tmp_path, rows, block=4)
    asked = spark.createDataFrame([("http://nowhere.example/",), ("http://hot.example",), ("http://hot.example",)], "url string")
    assert read_captures(asked, root).count() == 500


def test_binary_search_opens_one_block(spark, tmp_path, monkeypatch):
    rows = [(i, f"http://h{i:05}.example.com/", f"<p>{i}" * 50) for i in range(2000)]
    _, root = written(spark, tmp_path, rows, block=10)
    opened = []
    monkeypatch.setattr(Index, "read", lambda self, *a, read=Index.read: (opened.append(a), read(self, *a))[1])
    parts = {}
    for x in directory(spark, root).collect():
        parts.setdefault(x["part"], []).append(x.asDict())
    key = surt("http://h00777.example.com/")
    found = [e for of in parts.values() for e in Index(root, of).find(key)]
    assert [e[0] for e in found] == [key] and len(opened) == 1


def test_changed_archive_stops_the_job(spark, tmp_path):
    rows = [(i, f"http://h{i}.example.com/", f"<p>{i}" * 50) for i in range(20)]
    df, root = written(spark, tmp_path, rows)
    for f in Path(tmp_path, "w", "archive").glob("*.warc.gz"):
        data = f.read_bytes()
        f.write_bytes(data[:-200] + bytes(200))
    with pytest.raises(Exception, match="(?i)error|crc|not"):
        read_captures(df, root).collect()


def test_keys():
    assert surt("HTTP://user@WWW.Example.com:80/A?b#c") == "com,example,www)/A?b"
    assert surt("https://example.com:8080") == "com,example:8080)/"
    assert surt(None) == surt("") == "" and surt(warc._header("http://a/b c")) == surt("http://a/b c")


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_same_rows_as_sql(spark, sf):
    assert_same(spark, op13_warc, OP13_SQL, sf)
