"""Files to frames and back: routing by kind, tolerant rows, question rows, artifacts, session and audit sinks."""

from __future__ import annotations

import codecs
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions.normalize import json_array_in
from ledgerloom.functions.tables import read
from ledgerloom.operators.prefix import running_before

KINDS = {"pdf": ["pdf"], "word": ["doc", "docx"], "sheet": ["xls", "xlsx"], "html": ["html", "htm"], "image": ["png", "jpg", "jpeg", "bmp", "tif", "tiff", "webp"]}


def file_kind(path: Column) -> Column:
    """Kind by extension; `unsupported` for others."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    out = F.when(ext.isin(*KINDS["pdf"]), "pdf")
    for kind, names in list(KINDS.items())[1:]:
        out = out.when(ext.isin(*names), kind)
    return out.otherwise("unsupported")


def folder(spark: SparkSession, path: str) -> DataFrame:
    """(path, kind, length, content, error) of all files below a folder; unsupported ones have an error and no content is dropped silently."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    kind = file_kind(F.col("path"))
    return files.select("path", kind.alias("kind"), "length", "content", F.when(kind == "unsupported", F.lit("unsupported file type")).alias("error"))


def decoded_html(content: bytes) -> str:
    """Text of a page's bytes: a byte-order mark, else the charset named in the first 8 KiB, else UTF-8, else GB18030."""
    for mark, name in ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16")):
        if content.startswith(mark):
            return content.decode(name, "replace")
    named = re.search(rb"charset=[\"']?([A-Za-z0-9_-]+)", content[:8192])
    for name in [*([named[1].decode()] if named else []), "utf-8", "gb18030"]:
        try:
            return content.decode(name)
        except (LookupError, UnicodeDecodeError):
            continue
    return content.decode("utf-8", "replace")


def html_text(content: Column) -> Column:
    """Bytes of pages as text, by `decoded_html`; null stays null."""

    @F.pandas_udf("string")
    def decode(pages):
        return pages.map(lambda b: None if b is None else decoded_html(b))

    return decode(content)


def json_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; lines that don't parse are kept in `_corrupt`."""
    return spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def csv_rows(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    r = spark.read.option("header", "true")
    return (r.schema(schema) if schema else r).csv(path)


def record_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a CSV file with a header, a JSON list or JSON lines, as the file begins; what isn't an object is skipped. A list is read by one task, so large inputs should be lines."""
    if path.lower().endswith(".csv"):
        return csv_rows(spark, path, schema)
    begins = spark.read.text(path).where("trim(value) <> ''").select(F.left(F.trim("value"), F.lit(1))).first()
    if begins and begins[0] == "[":
        objects = spark.read.text(path, wholetext=True).select(F.explode(json_array_in(F.col("value"))).alias("o"))
        return objects.select(F.from_json("o", schema).alias("r")).select("r.*")
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def sparse_pages(pages: DataFrame, least: int = 80, mode: str = "auto", most: int = 8) -> DataFrame:
    """pages (doc_id, page, text) with `route`: ocr for pages with fewer than `least` characters that are not space, up to `most` of a document."""
    thin = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)\s+", "")) < least
    needs = F.lit(False) if mode == "off" else F.lit(True) if mode == "always" else thin
    order = Window.partitionBy("doc_id").orderBy("page")
    return pages.withColumn("_needs", needs).withColumn("route", F.when(F.col("_needs") & (F.sum(F.col("_needs").cast("int")).over(order) <= most), "ocr").otherwise("native")).drop("_needs")


def question_rows(rows: DataFrame, id_col: str, templates: dict[str, str]) -> DataFrame:
    """A wide row as question and answer documents: a question template with %s for each field that isn't empty."""
    name = F.col("name")
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.format_string(q, name).alias("question"), F.col(f).cast("string").alias("answer")) for f, q in templates.items()])
    return rows.select(id_col, F.explode(pairs).alias("p")).where("trim(p.answer) <> ''").select(id_col, "p.field", "p.question", "p.answer")


def benchmark_cases(raw: DataFrame, schema: str) -> DataFrame:
    """raw (dataset, json of a map id -> {question, options, answer}) as flat cases; options upper-cased and sorted, cases whose answer isn't an option go."""
    c = raw.select("dataset", F.explode(F.from_json("json", schema)).alias("raw_id", "c"))
    options = F.array_sort(F.transform(F.map_entries("c.options"), lambda e: F.struct(F.upper(e["key"]).alias("key"), e["value"].alias("value"))))
    out = c.select("dataset", "raw_id", F.col("c.question").alias("question"), options.alias("options"), F.upper(F.trim("c.answer")).alias("answer"))
    return out.where(F.exists("options", lambda o: o["key"] == F.col("answer")))


def progressive(chunks: DataFrame, pages: int = 20, first: int = 200) -> DataFrame:
    """chunks (doc_id, pos, page) with `batch`: those of early pages go first, and of the others those with less than `first` chunks of the document before them. A document of any size is in many tasks."""
    counted = running_before(chunks, "doc_id", "pos", F.lit(1), "_before")
    return counted.withColumn("batch", F.when((F.col("page") < pages) | (F.col("_before") < first), 0).otherwise(1)).drop("_before")


def replace_session(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All rows of a session are replaced by the new ones."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def audit(spark: SparkSession, events: DataFrame, path: str) -> None:
    events.write.mode("append").parquet(path)


#: Fields of a parser's JSON output that hold text, in the order in which an object's are taken.
TEXT_FIELDS = ["text", "content", "md", "markdown", "html"]


def json_text(c: Column, fields: list[str] = TEXT_FIELDS) -> Column:
    """Texts below a JSON value, each once, parents before children; empty where there are none or it isn't JSON."""

    @F.pandas_udf("string")
    def texts(values):
        import json

        def one(value):
            try:
                left, seen = [json.loads(value or "null")], {}
            except ValueError:
                return ""
            while left:
                node = left.pop()
                if isinstance(node, dict):
                    seen |= {node[f].strip(): None for f in fields if isinstance(node.get(f), str) and node[f].strip()}
                below = list(node.values()) if isinstance(node, dict) else node if isinstance(node, list) else []
                left.extend(reversed(below))
            return "\n\n".join(seen)

        return values.map(one)

    return texts(c)


def best_output(files: DataFrame) -> DataFrame:
    """files (doc_id, path, text): the largest markdown file of a document, else the text of the largest JSON that has some, else an empty text. Among equal sizes the last path."""
    md = F.endswith("path", F.lit(".md"))
    text = F.when(md, F.col("text")).when(F.endswith("path", F.lit(".json")), json_text(F.col("text")))
    f = files.select("doc_id", "path", F.octet_length("text").alias("size"), md.alias("md"), text.alias("text"))
    usable = F.col("md") | (F.trim("text") != "")
    return f.groupBy("doc_id").agg(F.coalesce(F.max_by(F.when(usable, F.col("text")), F.when(usable, F.struct("md", "size", "path"))), F.lit("")).alias("text"))


def ocr_blocks(results: DataFrame) -> DataFrame:
    """results (doc_id, json array of blocks): blocks in their order, or as listed, with label, box and confidence."""
    schema = "array<struct<block_label:string,block_content:string,block_bbox:array<double>,block_order:int,confidence:double>>"
    b = results.select("doc_id", F.posexplode(F.from_json("json", schema)).alias("pos", "b"))
    return b.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.coalesce("b.block_order", "pos"), "pos")).alias("n"), F.coalesce("b.block_label", F.lit("text")).alias("label"), F.col("b.block_content").alias("text"), "b.block_bbox", "b.confidence")


def sc4_page_routes(spark, d):
    p = read(spark, d, "documents").select((F.col("doc_id") % 40).alias("doc_id"), F.col("doc_id").alias("page"), "text")
    return sparse_pages(p).select("doc_id", "page", "route")


def sc11_questions(spark, d):
    p = read(spark, d, "part").select("p_partkey", F.col("p_name").alias("name"), "p_brand", F.when(F.col("p_size") > 25, F.col("p_type")).otherwise("").alias("p_type"))
    return question_rows(p, "p_partkey", {"p_brand": "What is the brand of %s?", "p_type": "Of which type is %s?"})


def sc21_progressive(spark, d):
    l = read(spark, d, "lineitem").select((F.col("l_suppkey") % 20).alias("doc_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), (F.col("l_partkey") % 60).alias("page"))
    return progressive(l).select("doc_id", "pos", "batch")


def sc1_kinds(spark, d):
    names = F.concat(F.col("p_name"), F.get(F.array(*[F.lit(x) for x in (".pdf", ".DOCX", ".html", ".txt", ".png", "")]), F.col("p_partkey").cast("int") % 6))
    return read(spark, d, "part").select("p_partkey", file_kind(names).alias("kind"))


def sc31_session(spark, d):
    c = read(spark, d, "conversations").select("conv_id", "turn", "role")
    return replace_session(c, c.where("conv_id % 10 = 0 and turn < 2").withColumn("role", F.upper("role")), "conv_id")


def sc5_outputs(spark, d):
    p, name = read(spark, d, "part"), F.col("p_name")
    file = lambda path, text: F.struct(F.lit(path).alias("path"), text.alias("text"))
    md = F.array(file("a/x.md", F.lit("short")), file("b.md", F.concat(F.lit("longer "), name)), file("z.json", F.concat(F.lit('{"text": "'), F.repeat(name, F.lit(9)), F.lit('"}'))))
    nested = F.concat(F.lit('{"pages": [{"text": " '), name, F.lit(' "}, {"md": "B", "text": "'), name, F.lit('"}, [{"content": "C"}]]}'))
    js = F.array(file("big.json", F.concat(F.lit('{"note": "'), F.repeat(name, F.lit(9)), F.lit('"}'))), file("some.json", nested), file("bad.json", F.lit("{")))
    files = F.when(F.col("p_partkey") % 3 == 0, md).when(F.col("p_partkey") % 3 == 1, js).otherwise(F.slice(js, 1, 1))
    return best_output(p.select(F.col("p_partkey").alias("doc_id"), F.explode(files).alias("f")).select("doc_id", "f.path", "f.text"))


def sc17_scan(spark, d):
    return read(spark, d, "embeddings").where("label = 3").orderBy("vec_id").offset(5).limit(20).select("vec_id", "label")


QUERIES = {f.__name__: f for f in (sc1_kinds, sc5_outputs, sc4_page_routes, sc11_questions, sc17_scan, sc21_progressive, sc31_session)}
SQL = {
    "sc1_kinds": "SELECT p_partkey, ['pdf', 'word', 'html', 'unsupported', 'image', 'unsupported'][p_partkey % 6 + 1] AS kind FROM part",
    "sc5_outputs": "SELECT p_partkey AS doc_id, CASE p_partkey % 3 WHEN 0 THEN 'longer ' || p_name WHEN 1 THEN p_name || chr(10) || chr(10) || 'B' || chr(10) || chr(10) || 'C' ELSE '' END AS text FROM part",
    "sc4_page_routes": r"WITH p AS (SELECT doc_id % 40 AS doc_id, doc_id AS page, length(regexp_replace(text, '\s+', '', 'g')) < 80 AS n FROM documents) SELECT doc_id, page, CASE WHEN n AND sum(n::INT) OVER (PARTITION BY doc_id ORDER BY page) <= 8 THEN 'ocr' ELSE 'native' END AS route FROM p",
    "sc11_questions": "SELECT p_partkey, 'p_brand' AS field, 'What is the brand of ' || p_name || '?' AS question, p_brand AS answer FROM part UNION ALL SELECT p_partkey, 'p_type', 'Of which type is ' || p_name || '?', p_type FROM part WHERE p_size > 25",
    "sc17_scan": "SELECT vec_id, label FROM embeddings WHERE label = 3 ORDER BY vec_id LIMIT 20 OFFSET 5",
    "sc21_progressive": "WITH c AS (SELECT l_suppkey % 20 AS doc_id, l_orderkey * 10 + l_linenumber AS pos, l_partkey % 60 AS page FROM lineitem) SELECT doc_id, pos, CASE WHEN page < 20 OR row_number() OVER (PARTITION BY doc_id ORDER BY pos) <= 200 THEN 0 ELSE 1 END AS batch FROM c",
    "sc31_session": "SELECT conv_id, turn, role FROM conversations WHERE conv_id % 10 <> 0 UNION ALL SELECT conv_id, turn, upper(role) FROM conversations WHERE conv_id % 10 = 0 AND turn < 2",
}
