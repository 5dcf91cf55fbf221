"""Compound files: what is written is read again, damaged ones carry nothing."""

import io
import random
import zipfile

import pytest

from docloom.sources import ole, ooxml


@pytest.mark.parametrize("sector", [512, 4096])
def test_streams_come_back(sector):
    rng = random.Random(1)
    sizes = (0, 1, 63, 64, 65, 4095, 4096, 4097, 70_000, 8_000_000)  # short ones, chains, and more tables than the header names
    streams = {(f"s{n}",): rng.randbytes(n) for n in sizes}
    streams |= {("ObjectPool", "_1", "\x01Ole10Native"): b"deep", ("ObjectPool", "_2", "Contents"): rng.randbytes(5000), ("Zz",): b"z"}
    box = ole.CompoundFile(ole.compound(streams, sector))
    assert {p: box.read(p) for p in box.streams} == streams


def test_payloads_by_stream_and_name():
    get = lambda streams, fallback="object1.bin": ole.payload(ole.compound(streams), fallback, ooxml.sniff)
    pdf, long = b"%PDF-1.7 x", b"text " * 3000
    assert get({(ole.NATIVE,): ole.native_stream("a b.txt", long)}) == ("a b.txt", long, "text/plain")
    assert get({("x", ole.NATIVE): ole.native_stream("note.txt", b"in a folder")})[:2] == ("note.txt", b"in a folder")
    assert get({(ole.NATIVE,): ole.native_stream("report.bin", pdf)}) == ("report.pdf", pdf, "application/pdf")
    assert get({(ole.NATIVE,): ole.native_stream("report", pdf)})[0] == "object1.pdf"  # no suffix: after the container
    assert get({(ole.NATIVE,): ole.native_stream("report.doc", pdf)})[0] == "report.doc"
    assert get({(ole.NATIVE,): ole.native_stream("C:\\in\\a.txt", b"x")})[0] == "C_in_a.txt"
    assert get({(ole.NATIVE,): ole.native_stream("", b"x")})[:2] == ("object1.bin", b"x")
    assert get({(ole.NATIVE,): ole.native_stream("package.txt", b"no size in front", sized=False)})[:2] == ("package.txt", b"no size in front")
    assert get({("contents",): pdf}) == ("object1.pdf", pdf, "application/pdf")
    assert get({("CONTENTS",): b"plain"}) == ("object1.bin", b"plain", "application/octet-stream")
    assert get({(ole.NATIVE,): ole.native_stream("empty.txt", b""), ("CONTENTS",): pdf}) is None  # a native stream decides alone
    assert get({(ole.NATIVE,): ole.native_stream("a.txt", b"x")[:-5]}) is None  # a link has no bytes
    assert get({("WordDocument",): long}) is None


def test_damaged_containers_carry_nothing():
    rng = random.Random(2)
    whole = ole.compound({(ole.NATIVE,): ole.native_stream("a.txt", b"abc " * 3000)})
    for _ in range(300):
        broken = bytearray(whole[: rng.choice([len(whole), rng.randrange(len(whole))])])
        for _ in range(rng.randint(1, 30)):
            if broken:
                broken[rng.randrange(min(len(broken), 700 if rng.random() < 0.5 else len(broken)))] = rng.randrange(256)
        found = ole.payload(bytes(broken), "f.bin", ooxml.sniff)
        assert found is None or isinstance(found[1], bytes)
    assert ole.payload(b"", "f", ooxml.sniff) is None and ole.payload(b"PK\3\4", "f", ooxml.sniff) is None


def test_payloads_of_a_table(spark):
    rows = [("/in/a.bin", bytearray(ole.compound({(ole.NATIVE,): ole.native_stream("a.txt", b"A")})), 1), ("/in/b.bin", bytearray(b"no container"), 2), ("/in/c.bin", None, 3), (None, bytearray(ole.compound({("CONTENTS",): b"%PDF-1"})), 4)]
    out = ole.payloads(spark.createDataFrame(rows, "path string, content binary, n int"))
    assert out.columns == ["path", "content", "n", "payload_name", "payload", "payload_type"]
    assert [(r["n"], r["payload_name"], r["payload"] and bytes(r["payload"]), r["payload_type"]) for r in out.orderBy("n").collect()] == [
        (1, "a.txt", b"A", "text/plain"), (2, None, None, None), (3, None, None, None), (4, "asset.pdf", b"%PDF-1", "application/pdf")]


def test_objects_in_word_files(spark):
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:o="urn:schemas-microsoft-com:office:office"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        objects = "".join(f'<w:p><w:r><w:object><o:OLEObject r:id="r{i}"/></w:object></w:r></w:p>' for i in (1, 2, 3))
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{objects}</w:body></w:document>")
        kind = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/oleObject"
        z.writestr("word/_rels/document.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Type="{kind}" Target="embeddings/oleObject{i}.bin"/>' for i in (1, 2, 3)) + "</Relationships>")
        for i, name in ((1, "a.tar.gz"), (2, "a.tar.gz"), (3, "a_2.tar.gz")):
            z.writestr(f"word/embeddings/oleObject{i}.bin", ole.compound({(ole.NATIVE,): ole.native_stream(name, b"x" * i)}))
    assets = ooxml.part(ooxml.parse(spark.createDataFrame([("d", bytearray(out.getvalue()))], "doc_id string, content binary")), "assets").orderBy("asset_id").collect()
    assert [(a["original_name"], a["stored_name"], bytes(a["content"])) for a in assets] == [("a.tar.gz", "a.tar.gz", b"x"), ("a.tar.gz", "a_2.tar.gz", b"xx"), ("a_2.tar.gz", "a_2_2.tar.gz", b"xxx")]
