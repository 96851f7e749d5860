"""PDF files: their pages by their own structure, and OCR shards that are asked for once."""

import zlib

import pytest

from pagewright.operators.pages import extract_pages
from pagewright.sources import pdf


def classic(pages, extra=b"", trailer=b""):
    """A file with a cross-reference table."""
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [%s] /Count %d >>" % (b" ".join(b"%d 0 R" % (3 + i) for i in range(pages)), pages)}
    objects |= {3 + i: b"<< /Type /Page /Parent 2 0 R /Note (a \\) paren (inner) % no comment) /X <0A ff> >>" for i in range(pages)}
    out, places = b"%PDF-1.4\n%\xe2\xe3\xcf\xd3\n" + extra, {}
    for n, body in objects.items():
        places[n] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    at = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % places[n] for n in sorted(places))
    return out + b"trailer\n<< /Size %d /Root 1 0 R %s>>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, trailer, at)


def updated(data, pages):
    """The same file with another list of pages appended."""
    prev = int(data.rsplit(b"startxref\n", 1)[1].split(b"\n")[0])
    place = len(data)
    data += b"2 0 obj\n<< /Type /Pages /Kids [] /Count %d >>\nendobj\n" % pages
    at = len(data)
    return data + b"xref\n2 1\n%010d 00000 n \ntrailer\n<< /Size 9 /Root 1 0 R /Prev %d >>\nstartxref\n%d\n%%%%EOF" % (place, prev, at)


def rows_up(raw, wide):
    out, above = b"", bytes(wide)
    for i in range(0, len(raw), wide):
        row = raw[i : i + wide]
        out += b"\x02" + bytes((x - y) & 255 for x, y in zip(row, above))
        above = row
    return out


def compressed(pages, predictor):
    """A file with a cross-reference stream, whose catalog and pages are in a stream of objects."""
    inner = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [] /Count 5 0 R >>", b"%d" % pages]
    numbers = [1, 2, 5]
    heads, body = [], b""
    for n, x in zip(numbers, inner):
        heads += [n, len(body)]
        body += x + b" "
    first = b" ".join(b"%d" % h for h in heads) + b" "
    packed = zlib.compress(first + body)
    out = b"%PDF-1.5\n"
    at3 = len(out)
    out += b"3 0 obj\n<< /Type /ObjStm /N 3 /First %d /Length 6 0 R /Filter /FlateDecode >>\nstream\n%s\nendstream\nendobj\n" % (len(first), packed)
    at6 = len(out)
    out += b"6 0 obj\n%d\nendobj\n" % len(packed)
    at4 = len(out)
    entries = {0: (0, 0, 65535), 1: (2, 3, 0), 2: (2, 3, 1), 3: (1, at3, 0), 4: (1, at4, 0), 5: (2, 3, 2), 6: (1, at6, 0)}
    raw = b"".join(k.to_bytes(1, "big") + x.to_bytes(3, "big") + y.to_bytes(2, "big") for k, x, y in entries.values())
    parms = b""
    if predictor:
        raw, parms = rows_up(raw, 6), b"/DecodeParms << /Predictor 12 /Columns 6 >> "
    table = zlib.compress(raw)
    out += b"4 0 obj\n<< /Type /XRef /Size 7 /W [1 3 2] /Index [0 7] /Root 1 0 R /Filter [/FlateDecode] %s/Length %d >>\nstream\r\n%s\nendstream\nendobj\n" % (parms, len(table), table)
    return out + b"startxref\n%d\n%%%%EOF\n" % at4


def test_page_counts():
    for n in (0, 1, 7, 250):
        assert pdf.page_count(classic(n)) == n and pdf.page_count(compressed(n, False)) == pdf.page_count(compressed(n, True)) == n
    assert pdf.page_count(updated(classic(3), 8)) == 8 and pdf.page_count(updated(updated(classic(3), 8), 1)) == 1


@pytest.mark.parametrize("data, says", [(b"", "no cross-reference"), (b"%PDF-1.4 hello", "no cross-reference"), (classic(2, trailer=b"/Encrypt 9 0 R "), "encrypted"), (classic(3)[:-200], "no cross-reference"), (classic(2).replace(b"/Count 2", b"/Count Q"), "how many pages"), (classic(2).replace(b"/Pages 2 0 R", b"/Pages 9 0 R"), "missing"), (b"startxref\n4\n%%EOF", "no object")])
def test_unreadable_files(data, says):
    with pytest.raises(pdf.Unreadable, match=says):
        pdf.page_count(data)


def test_predictors():
    raw = bytes(range(40))
    none = b"".join(b"\x00" + raw[i : i + 8] for i in range(0, 40, 8))
    assert pdf._unpredicted(none, 8) == raw == pdf._unpredicted(rows_up(raw, 8), 8)
    assert pdf._unpredicted(b"\x01\x01\x01\x01", 3) == b"\x01\x02\x03"
    assert pdf._unpredicted(b"\x00\x04\x08\x03\x02\x02", 2) == b"\x04\x08\x04\x08" and pdf._unpredicted(b"\x00\x0a\x14\x04\x01\x01", 2) == b"\x0a\x14\x0b\x15"


def test_files(spark, tmp_path):
    """As a table and as a stream that goes on where it stopped."""
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a.pdf").write_bytes(classic(3))
    (tmp_path / "in" / "sub" / "b.PDF").write_bytes(compressed(120, True))
    (tmp_path / "in" / "c.pdf").write_bytes(b"no pdf")
    (tmp_path / "in" / "d.txt").write_bytes(classic(1))
    got = {r.path.rsplit("/", 1)[1]: (r.size, r.has_magic, r.page_count, r.problem) for r in pdf.described(pdf.files(spark, str(tmp_path / "in"))).collect()}
    assert got == {"a.pdf": (len(classic(3)), True, 3, None), "b.PDF": (len(compressed(120, True)), True, 120, None), "c.pdf": (6, False, None, "no cross-reference")}

    def run():
        out = pdf.described(pdf.files(spark, str(tmp_path / "in"), stream=True)).select("path", "page_count")
        q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        assert q.awaitTermination(60)
        return sorted((r.path.rsplit("/", 1)[1], r.page_count) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == [("a.pdf", 3), ("b.PDF", 120), ("c.pdf", None)]
    (tmp_path / "in" / "e.pdf").write_bytes(classic(9))
    assert run() == [("a.pdf", 3), ("b.PDF", 120), ("c.pdf", None), ("e.pdf", 9)]


def test_shards_of_an_ocr_job(spark, tmp_path):
    """One call for each hundred pages; a document without any output is an error."""
    calls = tmp_path / "calls"
    calls.mkdir()
    folder = str(calls)

    def ocr(content, first, last):
        import uuid

        open(f"{folder}/{uuid.uuid4().hex}", "w").write(f"{first}-{last}")
        if content == b"blank":
            return None
        text = "".join(f"page {n} of {content.decode()}|" for n in range(first, last + 1))
        ends = [0]
        for t in text.split("|")[:-1]:
            ends.append(ends[-1] + len(t) + 1)
        return {"text": text, "pages": [{"pageNumber": n, "layout": {"textAnchor": {"textSegments": [{"startIndex": str(ends[i]), "endIndex": str(ends[i + 1] - 1)}]}}} for i, n in enumerate(range(first, last + 1))]}

    docs = spark.createDataFrame([("a", bytearray(b"a"), 250), ("b", bytearray(b"b"), 100)], "document_id string, content binary, page_count int")
    got = pdf.recognised(docs, ocr).collect()
    assert sorted((r.document_id, r.shard_index, len(r.pages)) for r in got) == [("a", 0, 100), ("a", 1, 100), ("a", 2, 50), ("b", 0, 100)]
    assert sorted(p.read_text() for p in calls.iterdir()) == ["1-100", "1-100", "101-200", "201-250"]
    pages = extract_pages(spark.createDataFrame(got, pdf.recognised(docs, ocr).schema), docs.select("document_id", "page_count"))
    assert {(r.document_id, r.page_number): r.extracted_text for r in pages.collect()} == {(d, n): f"page {n} of {d}" for d, k in (("a", 250), ("b", 100)) for n in range(1, k + 1)}
    none = spark.createDataFrame([("a", bytearray(b"a"), 1), ("c", bytearray(b"blank"), 3)], docs.schema)
    with pytest.raises(Exception, match="no OCR output for c"):
        pdf.recognised(none, ocr).collect()
    assert pdf.recognised(docs.limit(0), ocr).collect() == []
