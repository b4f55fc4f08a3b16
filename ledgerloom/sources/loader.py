"""Files of several kinds to pages of text: a parser behind each kind, and a row of error for each file that gives no text.

Files are frames (path, length, content), as Spark's binaryFile source reads them from any store and deals them to tasks by size. A
file is parsed where it is read; a broken one can't stop the others.
"""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.tables import read, small_batches
from ledgerloom.operators.chunking import html_sections
from ledgerloom.sources.readers import decoded_html, file_kind

PAGE = "path string, kind string, page int, text string, error string"
#: Greatest size of a file, and of what an archive unpacks to.
MAX_BYTES, MAX_UNPACKED = 256 << 20, 1 << 30
#: Rows, and characters of text, from which a batch of pages leaves a task.
OUT_ROWS, OUT_CHARS = 1000, 1 << 20


def _xml(archive: zipfile.ZipFile, name: str) -> ElementTree.Element:
    if archive.getinfo(name).file_size > MAX_UNPACKED:
        raise ValueError(f"{name} is too large")
    data = archive.read(name)
    if b"<!DOCTYPE" in data[:4096]:
        raise ValueError("document types aren't read")
    return ElementTree.fromstring(data)


def _named(element: ElementTree.Element, name: str):
    """Descendants by local name, in document order."""
    return (e for e in element.iter() if e.tag.rsplit("}", 1)[-1] == name)


def word_pages(content: bytes) -> list[str]:
    """The text of a .docx: its paragraphs as lines, tabs and breaks kept."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = _xml(z, "word/document.xml")
    mark = {"tab": "\t", "br": "\n", "cr": "\n"}
    lines = ["".join(e.text or "" if (n := e.tag.rsplit("}", 1)[-1]) == "t" else mark.get(n, "") for e in p.iter()) for p in _named(root, "p")]
    return ["\n".join(lines)]


def sheet_pages(content: bytes) -> list[str]:
    """A page for each sheet of an .xlsx: its rows as lines, cells joined by tabs."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in _named(s, "t")) for s in _named(_xml(z, "xl/sharedStrings.xml"), "si")]
        names = sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        if not names:
            raise ValueError("no sheets")
        out = []
        for name in names:
            rows = []
            for row in _named(_xml(z, name), "row"):
                cells = []
                for c in _named(row, "c"):
                    value = "".join(v.text or "" for v in _named(c, "v"))
                    cells.append(shared[int(value)] if c.get("t") == "s" and value else "".join(t.text or "" for t in _named(c, "t")) if c.get("t") == "inlineStr" else value)
                rows.append("\t".join(cells).rstrip("\t"))
            out.append("\n".join(rows).strip("\n"))
    return out


def html_pages(content: bytes) -> list[str]:
    return [text for _, text in html_sections(decoded_html(content))]


PARSERS = {"html": html_pages, "docx": word_pages, "xlsx": sheet_pages}
#: Kinds whose text comes from elsewhere.
ELSEWHERE = {"pdf": "pages come from a parser's outputs", "image": "text comes from recognition results", "doc": "old binary format", "xls": "old binary format"}


def parsed(path: str, kind: str, content: bytes | None) -> list[tuple[str, str, int | None, str | None, str | None]]:
    """Rows (PAGE) of one file: its pages, or one row with the error."""
    ext = path.rsplit(".", 1)[-1].lower()
    form = "html" if kind == "html" else ext
    if kind == "unsupported":
        return [(path, kind, None, None, "unsupported file type")]
    if form not in PARSERS:
        return [(path, kind, None, None, ELSEWHERE.get(form) or ELSEWHERE[kind])]
    if content is None:
        return [(path, kind, None, None, f"more than {MAX_BYTES} bytes")]
    try:
        pages = [(path, kind, i, text, None) for i, text in enumerate(PARSERS[form](content)) if text.strip()]
    except Exception as e:  # whatever a file holds, it costs only itself
        return [(path, kind, None, None, f"{type(e).__name__}: {e}"[:300])]
    return pages or [(path, kind, None, None, "no text")]


def pages_of(files: DataFrame) -> DataFrame:
    """files (path, length, content) -> PAGE. Files beyond MAX_BYTES, without a parser, broken or empty ones have one row each with an error."""
    kind = file_kind(F.col("path"))
    usable = kind.isin("html", "word", "sheet") & (F.col("length") <= MAX_BYTES)
    src = files.select("path", kind.alias("kind"), F.when(usable, F.col("content")).alias("content"))

    small_batches(files.sparkSession)

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("path", pa.string()), ("kind", pa.string()), ("page", pa.int32()), ("text", pa.string()), ("error", pa.string())])
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)
        rows, chars, done = [], 0, 0
        for b in batches:
            for i in range(b.num_rows):
                rows += parsed(*(b.column(c)[i].as_py() for c in range(3)))
                chars += sum(len(r[3] or "") for r in rows[done:])
                done = len(rows)
                if done >= OUT_ROWS or chars >= OUT_CHARS:  # texts can be large
                    yield batch(rows)
                    rows, chars, done = [], 0, 0
        if rows:
            yield batch(rows)

    return src.mapInArrow(run, PAGE)


def load_documents(spark: SparkSession, path: str) -> DataFrame:
    """PAGE rows of all files below a folder of any store that Spark reads. Files of no bytes have no rows: Spark's file sources leave them out."""
    return pages_of(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "content"))


# queries


def sc2_loaded(spark, d):
    """Files made of parts: pages in three encodings, broken and old files, and kinds without a parser."""
    n = F.col("p_partkey") % 8
    ext = F.get(F.array(*[F.lit(x) for x in (".html", ".HTM", ".html", ".docx", ".xls", ".txt", ".pdf", ".html")]), n.cast("int"))
    page = F.concat(F.lit("<html><head><title>"), F.col("p_brand"), F.lit("</title><script>x = 1</script></head><body><h1>"), F.col("p_name"), F.lit("</h1><p>de "), F.col("p_type"), F.lit(" &amp; é</p></body></html>"))
    content = F.when(n == 1, F.concat(F.unhex(F.lit("FFFE")), F.encode(page, "UTF-16LE"))).when(n == 2, F.encode(F.concat(F.lit('<meta charset="iso-8859-1">'), page), "ISO-8859-1")).when(n == 7, F.encode(F.lit("<html></html>"), "UTF-8")).otherwise(F.encode(page, "UTF-8"))
    parts = read(spark, d, "part").repartition("p_partkey")  # many files of a small table, so that all tasks parse
    files = parts.select(F.concat(F.lit("/in/"), F.col("p_partkey"), ext).alias("path"), content.alias("content")).withColumn("length", F.length("content").cast("bigint"))
    return pages_of(files)


QUERIES = {"sc2_loaded": sc2_loaded}
SQL = {
    "sc2_loaded": """
        WITH f AS (SELECT *, p_partkey % 8 AS n, '/in/' || p_partkey || ['.html', '.HTM', '.html', '.docx', '.xls', '.txt', '.pdf', '.html'][p_partkey % 8 + 1] AS path FROM part)
        SELECT path, CASE n WHEN 3 THEN 'word' WHEN 4 THEN 'sheet' WHEN 5 THEN 'unsupported' WHEN 6 THEN 'pdf' ELSE 'html' END AS kind, CASE WHEN n < 3 THEN 0 END AS page,
            CASE WHEN n < 3 THEN '[' || p_brand || ']' || chr(10) || '# ' || p_name || chr(10) || 'de ' || p_type || ' & é' END AS text,
            CASE n WHEN 3 THEN 'BadZipFile: File is not a zip file' WHEN 4 THEN 'old binary format' WHEN 5 THEN 'unsupported file type' WHEN 6 THEN 'pages come from a parser''s outputs' WHEN 7 THEN 'no text' END AS error FROM f"""
}
