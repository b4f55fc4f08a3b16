import io
import zipfile

from ledgerloom.sources import loader

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def archive(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


DOCX = archive({"word/document.xml": f"<w:document {W}><w:body><w:p><w:r><w:t>One é</w:t><w:tab/><w:t>two</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>three</w:t></w:r></w:p></w:body></w:document>"})
XLSX = archive(
    {
        "xl/sharedStrings.xml": f"<sst {S}><si><t>name</t></si><si><r><t>a</t></r><r><t>b</t></r></si></sst>",
        "xl/worksheets/sheet1.xml": f'<worksheet {S}><sheetData><row><c t="s"><v>0</v></c><c><v>1.5</v></c></row><row><c t="s"><v>1</v></c><c t="inlineStr"><is><t>in</t></is></c></row></sheetData></worksheet>',
        "xl/worksheets/sheet2.xml": f"<worksheet {S}><sheetData/></worksheet>",
        "xl/worksheets/sheet10.xml": f"<worksheet {S}><sheetData><row><c><v>9</v></c></row></sheetData></worksheet>",
    }
)


def test_folder_of_good_and_bad_files(spark, tmp_path):
    page = "<html><head><title>T</title></head><body><h2>甲</h2><p>乙</p><h2>丙</h2><p>丁</p></body></html>"
    files = {
        "a.html": page.encode("gb18030"), "sub/b.HTM": page.encode("utf-16"), "c.docx": DOCX, "d.xlsx": XLSX, "e.docx": DOCX[:40], "f.xlsx": archive({"x": "y"}), "g.docx": archive({"word/document.xml": "<a><b></a>"}),
        "h.txt": b"text", "i.pdf": b"%PDF-1.4", "j.png": b"\x89PNG", "k.doc": b"old", "l.html": b" ", "m.docx": archive({"word/document.xml": "<!DOCTYPE x [<!ENTITY e 'e'>]><a>&e;</a>"}), "n": b" ",
    }
    for name, data in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    rows = loader.load_documents(spark, str(tmp_path)).collect()
    by = {}
    for r in sorted(rows, key=lambda r: r.page or 0):
        by.setdefault(r.path.rsplit("/", 1)[-1], []).append(r)
    assert set(by) == {n.rsplit("/", 1)[-1] for n in files}
    texts = lambda n: [r.text for r in by[n]]
    assert texts("a.html") == texts("b.HTM") == ["[章节: 甲]\n## 甲\n乙", "[章节: 丙]\n## 丙\n丁"]
    assert texts("c.docx") == ["One é\ttwo\n\nthree"]
    assert [(r.page, r.text) for r in by["d.xlsx"]] == [(0, "name\t1.5\nab\tin"), (2, "9")]
    bad = {n: by[n][0].error for n in "e.docx f.xlsx g.docx h.txt i.pdf j.png k.doc l.html m.docx n".split()}
    assert all(len(by[n]) == 1 and by[n][0].text is None and bad[n] for n in bad)
    assert bad["h.txt"] == bad["n"] == "unsupported file type" and bad["l.html"] == "no text" and "ParseError" in bad["g.docx"] and "no sheets" in bad["f.xlsx"] and "document types" in bad["m.docx"]


def test_files_that_are_too_large(spark, monkeypatch):
    monkeypatch.setattr(loader, "MAX_BYTES", 3)
    files = spark.createDataFrame([("a.html", 9, b"<p>x</p>"), ("b.html", None, None)], "path string, length long, content binary")
    rows = loader.pages_of(files).collect()
    assert len(rows) == 2 and all(r.error for r in rows)
    assert loader.pages_of(files.limit(0)).count() == 0


def test_small_files_share_batches(spark, monkeypatch):
    monkeypatch.setattr(loader, "OUT_ROWS", 40)
    files = spark.range(0, 100, 1, 1).selectExpr("concat('f', id, '.html') path", "9L length", "cast(concat('<p>', id, '</p>') as binary) content")
    made = []
    real = type(files).mapInArrow
    monkeypatch.setattr(type(files), "mapInArrow", lambda self, f, schema: made.append(f) or real(self, f, schema))
    rows = loader.pages_of(files).collect()
    assert sorted(r.text for r in rows) == sorted(str(i) for i in range(100))
    batches = [b.num_rows for b in made[0](files.selectExpr("path", "'html' kind", "content").toArrow().to_batches())]
    assert sum(batches) == 100 and len(batches) == 3
    monkeypatch.setattr(loader, "OUT_CHARS", 1)
    assert len(list(made[0](files.selectExpr("path", "'html' kind", "content").toArrow().to_batches()))) == 100
