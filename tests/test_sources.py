import io
import json
import struct
import zipfile

from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo

from fathomweave.functions import annotate
from fathomweave.operators import packets, sections, steps
from fathomweave.sources import capture, docx, layers, pcap

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def made(paragraphs):
    body = "".join(f'<w:p><w:pPr><w:pStyle w:val="{s}"/></w:pPr><w:r>' + "<w:tab/>".join(f"<w:t>{x}</w:t>" for x in t.split("\t")) + "</w:r></w:p>" for s, t in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", f'<w:styles {W}><w:style w:styleId="H5"><w:name w:val="heading 5"/></w:style></w:styles>')
    return out.getvalue()


def test_documents_to_steps(spark, tmp_path):
    (tmp_path / "a_new.docx").write_bytes(made([("Normal", "Preface"), ("H5", "6.1.3.2.0\t5G AKA"), ("Normal", "Figure 6.1.3.2-1: flow"), ("Normal", "1.\tThe UE asks."), ("Normal", "more"), ("Normal", "2.\tThe AMF answers."), ("H6", "General")]))
    (tmp_path / "b_new.docx").write_bytes(b"no zip")
    (tmp_path / "c.docx").write_bytes(b"not read")
    got = docx.read_documents(spark, str(tmp_path))
    assert got.where("error is not null").count() == 1
    made_sections = sections.assemble(got.where("error is null")).orderBy("section_seq").collect()
    assert [(r["clause"], r["has_figure"], r["title"]) for r in made_sections] == [("6.1.3.2.0", True, "6.1.3.2.0\t5G AKA"), ("G", False, "General")]
    parsed = steps.parse(spark.createDataFrame([("p", made_sections[0]["text"])], "procedure string, text string")).orderBy("ord").collect()
    assert [(r["number"], r["description"]) for r in parsed] == [("1", "The UE asks. more"), ("2", "The AMF answers.")]


def test_section_variants(spark):
    rows = [("d_new", 0, i, s, t) for i, (s, t) in enumerate([("Normal", "before"), ("Heading 1", "1 Scope"), ("Normal", "text one"), ("Heading 2", "2\tTwo"), ("Heading 3", "3 Three"), ("Normal", "end")])]
    p = spark.createDataFrame(rows, "document string, doc_seq int, para_seq int, style string, text string")
    assert [(r["clause"], r["text"]) for r in sections.ontology_sections(p).orderBy("section_seq").collect()] == [("Unknown", "before"), ("1 Scope", "text one"), ("3 Three", "end")]
    assert [(r["title"], r["text"]) for r in sections.requirement_sections(p).orderBy("section_seq").collect()] == [("1 Scope", "text one"), ("3 Three", "end")]
    # a header met while its section is empty becomes text
    assert [(r["title"], r["text"]) for r in sections.recognised_sections(p).orderBy("section_seq").collect()] == [("Introduction", "before"), ("1 Scope", "text one"), ("2\tTwo", "3 Three end")]
    none = p.where("false")
    assert sections.assemble(none).count() == sections.recognised_sections(none).count() == 0


def test_step_split(spark):
    t = spark.createDataFrame([("x 1.\tFirst 2.\tSecond 7-12.\tRange",)], "text string")
    assert t.select(steps.split_lines(F.col("text"))).first()[0] == "x \n1. First \n2. Second 7-\n12. Range"
    assert t.select(steps.split_lines(F.col("text"), strict=True)).first()[0] == "x \n1. First \n2. Second \n7-12. Range"


def frame(protocol, inner):
    ip = struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(inner), 0, 0, 64, protocol, 0, bytes([10, 0, 0, 1]), bytes([10, 0, 0, 2])) + inner
    return b"\0" * 12 + b"\x08\x00" + ip


def test_captures(spark, tmp_path):
    tcp = lambda body: struct.pack(">HHIIBBHHH", 80, 81, 0, 0, 5 << 4, 0, 0, 0, 0) + body
    frames = [frame(6, tcp(b'POST {"a": {"b": 1}} x')), frame(6, tcp(b"plain")), frame(17, struct.pack(">HHHH", 8805, 8805, 20, 0) + b"\x20\x32\x00\x08"), frame(132, struct.pack(">HHII", 1, 2, 0, 0) + struct.pack(">BBHIHHI", 0, 3, 16, 0, 0, 0, 60)), frame(1, b"ping")]
    data = struct.pack("<IHHIIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1) + b"".join(struct.pack("<IIII", 0, 0, len(f), len(f)) + f for f in frames)
    (tmp_path / "x.pcap").write_bytes(data)
    ng = struct.pack("<IIIHHqI", 0x0A0D0D0A, 28, 0x1A2B3C4D, 1, 0, -1, 28) + struct.pack("<IIHHII", 1, 20, 1, 0, 0, 20)
    for f in frames:
        pad = -len(f) % 4
        ng += struct.pack("<IIIIIII", 6, 32 + len(f) + pad, 0, 0, 0, len(f), len(f)) + f + b"\0" * pad + struct.pack("<I", 32 + len(f) + pad)
    (tmp_path / "y.pcapng").write_bytes(ng)
    got = packets.project(pcap.read_captures(spark, str(tmp_path))).orderBy("num").collect()
    assert [(r["num"], r["protocol"]) for r in got] == [("1", "TCP")] * 2 + [("3", "UDP")] * 2 + [("4", "SCTP")] * 2
    assert json.loads(got[0]["payload"]) == {"a": {"b": 1}} and got[0]["src"] == "10.0.0.1" and got[0]["dst_port"] == "81"


def test_annotators(spark):
    t = spark.createDataFrame([(1, "One two. " * 40), (2, ""), (3, None)], "id int, text string")
    parts = {r["id"]: r["c"] for r in t.select("id", annotate.chunk_column(F.col("text"), 10).alias("c")).collect()}
    assert all(len(c.split()) <= 10 for c in parts[1]) and " ".join(parts[1]).split() == ("One two. " * 40).split() and parts[2] == parts[3] == []
    v = {r["id"]: r["v"] for r in annotate.embed(t, "text", "v").collect()}
    assert len(v[1]) == 64 and v[3] is None and abs(sum(x * x for x in v[1]) - 1) < 1e-5
    shout = annotate.answers(t, F.col("text"), "a", lambda: lambda ps: [(p or "").upper() for p in ps])
    assert shout.where("id = 1").first()["a"].startswith("ONE TWO")


def ie(kind, value):
    return struct.pack(">HH", kind, len(value)) + value


PFCP_MESSAGE = b"\x21\x32" + struct.pack(">H", 12 + 0) + struct.pack(">Q", 77) + b"\0\0\x05\0"
ELEMENTS = ie(1, ie(56, b"\0\1") + ie(2, ie(20, b"\0") + ie(93, b"\2\x0a\0\0\1")) + ie(29, b"\0\0\0\xff")) + ie(3, ie(108, b"\0\0\0\1") + ie(4, ie(42, b"\1"))) + ie(1, ie(56, b"\0\2")) + ie(0x8001, b"\0\x0aab")


def pfcp_message(elements=ELEMENTS):
    body = struct.pack(">Q", 77) + b"\0\0\x05\0" + elements
    return b"\x21\x32" + struct.pack(">H", len(body)) + body


def test_nested_layers():
    got = layers.pfcp(pfcp_message())
    assert got["seid"] == "77" and got["seq_number"] == "5" and got["msg_type"] == "50"
    assert got["create_pdr"] == [{"pdr_id": "00:01", "pdi": {"source_interface": "00", "ue_ip_address": "02:0a:00:00:01"}, "precedence": "00:00:00:ff"}, {"pdr_id": "00:02"}]
    assert got["create_far"] == {"far_id": "00:00:00:01", "forwarding_parameters": {"destination_interface": "01"}}
    assert got["ie_32769"] == {"enterprise": "10", "value": "61:62"}
    init = struct.pack(">BBH", 1, 0, 20 + 8) + bytes(range(16)) + struct.pack(">HH", 5, 8) + bytes([10, 0, 0, 1])
    chunk = layers.sctp(struct.pack(">HHII", 1, 2, 9, 0) + init)["chunks"][0]
    assert chunk["fields"]["ipv4_address"] == "0a:00:00:01"
    assert layers.nas(bytes([0x7E, 2, 1, 2, 3, 4, 7, 0x7E, 0, 0x41, 9]))["message"] == {"discriminator": "mobility", "msg_type": "65", "body": "09"}
    assert layers.nas_elements(bytes([0xB3, 0x10, 1, 5, 0x71, 0, 2, 6, 7, 0x10, 1, 8])) == {"element_b_": "3", "element_10": ["05", "08"], "element_71": "06:07"}
    for cut in range(len(pfcp_message())):  # whatever is missing, nothing raises
        assert isinstance(layers.pfcp(pfcp_message()[:cut]), dict)


def fragments(inner, ident, size=40):
    out = []
    for at in range(0, len(inner), size):
        part = inner[at : at + size]
        flags = at // 8 | (0x2000 if at + size < len(inner) else 0)
        out.append(b"\0" * 12 + b"\x08\x00" + struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(part), ident, flags, 64, 17, 0, bytes([10, 0, 0, 1]), bytes([10, 0, 0, 3])) + part)
    return out


def pcap_bytes(frames):
    return struct.pack("<IHHIIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1) + b"".join(struct.pack("<IIII", 0, 0, len(f), len(f)) + f for f in frames)


def udp(body):
    return struct.pack(">HHHH", 8805, 8805, 8 + len(body), 0) + body


def test_fragments_out_of_order(spark, tmp_path):
    whole = udp(pfcp_message())
    a, b = fragments(whole, 7), fragments(udp(pfcp_message(ie(19, b"\1"))), 7, 8)
    lost = fragments(whole, 8)[:-1]
    # the same identification is used again once it is complete
    (tmp_path / "f.pcap").write_bytes(pcap_bytes([*a[::-1], *lost, frame(17, udp(pfcp_message())), b[2], *b[:2], *b[3:]]))
    got = packets.as_variant(packets.project(pcap.read_captures(spark, str(tmp_path)))).select("num", "protocol", F.expr("variant_get(payload, '$.create_pdr[0].pdi.source_interface', 'string')").alias("x"), F.expr("variant_get(payload, '$.cause', 'string')").alias("c")).collect()
    n = len(a)
    assert sorted((int(r["num"]), r["x"], r["c"]) for r in got) == [(n, "00", None), (n + len(lost) + 1, "00", None), (n + len(lost) + 1 + len(b), None, "01")]


def many(n):
    tcp = lambda body: struct.pack(">HHIIBBHHH", 80, 81, 0, 0, 5 << 4, 0, 0, 0, 0) + body
    return [frame(6, tcp(b'{"i": %d}' % i)) if i % 3 else frame(1, b"ping") for i in range(n)]


def test_capture_is_cut_between_blocks(spark, tmp_path):
    (tmp_path / "x.pcap").write_bytes(pcap_bytes(many(900)))
    ng = struct.pack("<IIIHHqI", 0x0A0D0D0A, 28, 0x1A2B3C4D, 1, 0, -1, 28) + struct.pack("<IIHHII", 1, 20, 1, 0, 0, 20)
    for f in many(500):
        pad = -len(f) % 4
        ng += struct.pack("<IIIIIII", 6, 32 + len(f) + pad, 0, 0, 0, len(f), len(f)) + f + b"\0" * pad + struct.pack("<I", 32 + len(f) + pad)
    (tmp_path / "y.pcapng").write_bytes(ng + ng)  # a second section starts anew
    one, several = pcap.read_captures(spark, str(tmp_path)), pcap.read_captures(spark, str(tmp_path), partition_bytes=4000)
    key = lambda df: sorted((r["file"], int(r["num"]), r["hex_payload"] or "") for r in df.collect())
    assert several.rdd.getNumPartitions() > 20 > one.rdd.getNumPartitions()
    assert key(several) == key(one) and len(key(one)) == 900 + 1000


def test_filters_reach_the_source(spark, tmp_path):
    (tmp_path / "x.pcap").write_bytes(pcap_bytes(many(30) + fragments(udp(b"hello"), 1)))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = pcap.read_captures(spark, str(tmp_path)).where("dst = '10.0.0.2' and length > 3")
        assert df.count() == 30
        reader = capture.FilteredCaptureReader(df.schema, {"path": str(tmp_path)})
        left = list(reader.pushFilters([EqualTo(("dst",), "10.0.0.3"), EqualTo(("num",), "1")]))
        assert left == [EqualTo(("num",), "1")]
        assert [x for p in reader.partitions() for x in capture._rows(p, "whole", reader.wanted)][0]["dst"] == "10.0.0.3"
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_captures_as_a_stream(spark, tmp_path):
    """New files, and what is added to a file, a half-written block included, come once each."""
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    all_ = many(40)
    data = pcap_bytes(all_)
    cut = len(pcap_bytes(all_[:25])) + 9
    (src / "a.pcap").write_bytes(data[:cut])
    pcap.ship(spark)
    spark.dataSource.register(capture.CaptureSource)
    stream = spark.readStream.format("captures").load(str(src)).select("file", "num", "hex_payload")
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    assert spark.read.parquet(out).count() == 25
    (src / "a.pcap").write_bytes(data)
    (src / "b.pcap").write_bytes(pcap_bytes(all_[:4]))
    q.processAllAvailable()
    q.stop()
    got = [(r["file"][-6:], int(r["num"])) for r in spark.read.parquet(out).collect()]
    assert sorted(got) == [("a.pcap", i + 1) for i in range(40)] + [("b.pcap", i + 1) for i in range(4)]
