"""Documents to lines, blocks, sections and chunks."""

from __future__ import annotations

import hashlib
import re
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.tables import read, small_batches
from ledgerloom.functions.text import collapsed

# Words of headings, and the patterns of headings and list items.
HEADING_WORDS = ["摘要", "引言", "背景", "目的", "方法", "结果", "结论", "讨论", "诊断", "治疗", "症状", "病因", "检查", "用药", "预防", "参考文献"]
# Further numbers after the first one (1.2.3) need no part of their own: they begin with the separator that has to follow it.
HEADING = r"^(#{1,6}\s+|第[一二三四五六七八九十百千0-9]+[章节篇部分]\s*|(\p{Nd}+|[一二三四五六七八九十]+)[.．、]\s*)\S+"
LIST = r"^(\p{Nd}+[.)、]|[-*•·])\s*\S+"
#: (size, overlap) of the three levels.
LEVELS = [(2400, 400), (1600, 200), (800, 100)]
SEPARATORS = ["\n\n", "。", "！", "？", "\n", "，", "、", " ", ""]


def windows(text: Column, size: int, overlap: int) -> Column:
    """array<string>: fixed windows of `size` characters that overlap; the last one reaches the end. None for blank texts."""
    step = size - overlap
    last = F.greatest(F.ceil((F.length(text) - size) / step), F.lit(0)).cast("int")
    return F.when(F.trim(text) != "", F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(text, i * step + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def line_kind(line: Column, heading_words: list[str] = HEADING_WORDS) -> Column:
    """heading, table, list, paragraph, or blank."""
    s = F.trim(line)
    flat = F.regexp_replace(s, r"\s+", " ")
    bare = F.regexp_replace(flat, "^[:：]+|[:：]+$", "")
    listed = F.array(*[F.lit(w) for w in heading_words])
    heading = flat.rlike(HEADING) | F.array_contains(listed, bare) | ((F.length(flat) <= 36) & ~flat.rlike("[。！？；，、,.!?;]$") & F.exists(listed, lambda w: F.contains(flat, w)))
    pipes = F.length(s) - F.length(F.replace(s, F.lit("|"), F.lit("")))
    table = (pipes >= 2) | F.contains(s, F.lit("\t")) | s.rlike(r"\S\s{2,}\S\s{2,}\S")
    return F.when(s == "", "blank").when(heading, "heading").when(table, "table").when(s.rlike(LIST), "list").otherwise("paragraph")


def blocks(docs: DataFrame, heading_words: list[str] = HEADING_WORDS) -> DataFrame:
    """(doc_id, block, kind, path, text): runs of lines of one kind within a document.

    Blank lines and headings end a block; fenced code is one block. `path` is the last two headings before
    it. Windows go over one document's lines; documents must be distinct by id.
    """
    w = Window.partitionBy("doc_id").orderBy("n")
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("n", "line"))
    fence = F.trim("line").startswith("```")
    lines = lines.withColumn("fences", F.sum(fence.cast("int")).over(w))
    code = fence | (F.col("fences") % 2 == 1)
    lines = lines.withColumn("kind", F.when(code, "code").otherwise(line_kind(F.col("line"), heading_words)))
    before = F.lag("kind").over(w)
    lines = lines.withColumn("new", (before.isNull() | (before != F.col("kind")) | F.col("kind").isin("heading", "blank")).cast("int"))
    lines = lines.withColumn("block", F.sum("new").over(w)).withColumn("head", F.when(F.col("kind") == "heading", F.trim(F.regexp_replace(collapsed(F.col("line")), "^#+", ""))))
    lines = lines.withColumn("last", F.last("head", ignorenulls=True).over(w))
    prior = F.last("last_before", ignorenulls=True).over(w)
    lines = lines.withColumn("last_before", F.when(F.col("head").isNotNull(), F.lag("last").over(w))).withColumn("prior", prior)
    out = lines.where("kind <> 'blank'").groupBy("doc_id", "block").agg(F.min("n").alias("at"), F.first("kind").alias("kind"), F.min_by("last", "n").alias("l"), F.min_by("prior", "n").alias("p"), F.sort_array(F.collect_list(F.struct("n", F.when(F.col("kind") == "heading", collapsed(F.col("line"))).otherwise(F.rtrim("line")).alias("s")))).alias("ls"))
    return out.select("doc_id", F.col("at").alias("block"), "kind", F.concat_ws(" > ", "p", "l").alias("path"), F.trim(F.array_join(F.transform("ls", lambda x: x["s"]), "\n")).alias("text"))


def split_text(text: str, size: int, overlap: int, separators: list[str] = SEPARATORS) -> list[str]:
    """Pieces of at most `size` characters, in order, each a substring of the text.

    The first separator that occurs splits and stays at the start of the right piece; pieces that are still too
    long are split by the next ones; neighbours are packed greedily, and pieces of the tail that fit in `overlap` are repeated.
    """
    if len(text) <= size:
        return [text] if text.strip() else []
    sep, rest = "", []
    for i, s in enumerate(separators):
        if s == "" or s in text:
            sep, rest = s, separators[i + 1 :]
            break
    if sep == "":
        step = max(1, size - overlap)
        return [text[i : i + size] for i in range(0, max(1, len(text) - overlap), step)]
    parts = text.split(sep)
    parts = [parts[0], *[sep + p for p in parts[1:]]]
    out: list[str] = []
    pack: list[str] = []
    for p in (p for p in parts if p):
        if len(p) > size:
            if pack:
                out.append("".join(pack))
                pack = []
            out += split_text(p, size, overlap, rest)
            continue
        if sum(map(len, pack)) + len(p) > size:
            out.append("".join(pack))
            while pack and (sum(map(len, pack)) > overlap or sum(map(len, pack)) + len(p) > size):
                pack.pop(0)
        pack.append(p)
    if pack:
        out.append("".join(pack))
    return [p for p in out if p.strip()]


def three_levels(pages: DataFrame, levels=LEVELS) -> DataFrame:
    """pages (doc_id, filename, page, text) -> chunks with chunk, parent and root ids, level and index in the page."""

    small_batches(pages.sparkSession)

    def run(frames):
        import pandas as pd

        for f in frames:
            rows = []
            for doc, name, page, text in zip(f["doc_id"], f["filename"], f["page"], f["text"]):
                count = [0, 0, 0]

                def walk(part, level, parent, root):
                    for piece in split_text(part, *levels[level]):
                        id_ = f"{name}::p{page}::l{level + 1}::{count[level]}"
                        rows.append((doc, id_, parent, root or id_, level + 1, count[level], piece))
                        count[level] += 1
                        if level < 2:
                            walk(piece, level + 1, id_, root or id_)

                walk(text or "", 0, "", "")
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_id", "parent_chunk_id", "root_chunk_id", "chunk_level", "chunk_idx", "text"])

    return pages.mapInPandas(run, "doc_id long, chunk_id string, parent_chunk_id string, root_chunk_id string, chunk_level int, chunk_idx int, text string")


class _Sections(HTMLParser):
    NOISE = {"script", "style", "noscript", "template", "iframe", "svg"}
    BLOCK = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "td", "th", "blockquote", "pre", "figcaption", "dt", "dd"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title, self.lines, self.now, self.quiet, self.tag, self.in_title = "", [], [], 0, "", False

    def flush(self):
        text = re.sub(r"[ \t\r\f\v]+", " ", "".join(self.now)).strip()
        if text:
            level = int(self.tag[1]) if re.fullmatch("h[1-4]", self.tag) else 0
            self.lines.append(("#" * level + " " if level else "") + text)
        self.now = []

    def handle_starttag(self, tag, attrs):
        if tag in self.NOISE:
            self.quiet += 1
        elif tag == "title":
            self.in_title = True
        elif tag == "br":
            self.now.append("\n")
        elif tag in self.BLOCK:
            self.flush()
            self.tag = tag

    def handle_endtag(self, tag):
        if tag in self.NOISE:
            self.quiet = max(0, self.quiet - 1)
        elif tag == "title":
            self.in_title = False
        elif tag in self.BLOCK:
            self.flush()
            self.tag = ""

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        elif not self.quiet:
            self.now.append(data)


def html_sections(html: str | None) -> list[tuple[int, str]]:
    """Sections of a page: the main, article or body part, in lines by block, split at second-level headings. One section is prefixed by the title."""
    html = html or ""
    for root in ("main", "article", "body"):
        got = re.search(rf"(?is)<{root}[\s>].*?</{root}>", html)
        if got:
            break
    head = _Sections()
    head.feed(re.search(r"(?is)<title.*?</title>", html)[0] if re.search(r"(?is)<title.*?</title>", html) else "")
    p = _Sections()
    p.feed(got[0] if got else html)
    p.close()
    p.flush()
    text, title = "\n".join(p.lines), head.title.strip()
    parts = [s.strip() for s in re.split(r"(?m)^(?=## .+$)", text) if s.strip()]
    if len(parts) <= 1:
        return [(0, f"[{title}]\n{text}" if title else text)] if text else []
    return [(i, f"[章节: {re.match('#+ (.*)', s)[1]}]\n{s}" if s.startswith("#") else s) for i, s in enumerate(parts)]


def hash_embedding(texts: Column, dim: int = 64) -> Column:
    """Character bigrams in signed hash buckets, with unit length; blank texts give zeros."""

    @F.pandas_udf("array<double>")
    def embed(s):
        import numpy as np

        known: dict[str, tuple[int, float]] = {}

        def one(t):
            v = np.zeros(dim)
            t = (t or "").strip()
            for a, b in zip(t, t[1:] or t):
                g = a + b
                if g not in known:
                    h = hashlib.blake2b(g.encode("utf-8", "surrogatepass"), digest_size=8).digest()
                    n = int.from_bytes(h, "big")
                    known[g] = (n % dim, 1.0 if n >> 63 == 0 else -1.0)
                k, sign = known[g]
                v[k] += sign
            n = float(np.sqrt((v * v).sum()))
            return (v / n if n else v).tolist()

        return s.map(one)

    return embed(texts)


def namespaced(chunks: DataFrame, document_id: Column) -> DataFrame:
    """chunks (chunk_id, parent_chunk_id): ids within a document; parents that don't exist become empty."""
    scoped = lambda c: F.concat(document_id, F.lit(":"), F.left(F.sha2(c, 256), F.lit(32)))
    there = chunks.select(F.col("chunk_id").alias("p")).distinct()
    out = chunks.join(there, F.col("parent_chunk_id") == F.col("p"), "left")
    return out.withColumn("parent_chunk_id", F.when(F.col("p").isNotNull(), scoped(F.col("parent_chunk_id"))).otherwise(F.lit(""))).withColumn("chunk_id", scoped(F.col("chunk_id"))).drop("p")


def public_id(filename: Column) -> Column:
    return F.concat(F.lit("public-"), F.left(F.sha2(F.lower(F.trim(filename)), 256), F.lit(40)))


def _docs(spark, d):
    return read(spark, d, "documents")


def ch7_window_split(spark, d):
    return _docs(spark, d).select("doc_id", F.posexplode(windows(F.col("text"), 1200, 120)).alias("chunk", "text")).select("doc_id", F.col("chunk").cast("bigint").alias("chunk"), F.length("text").cast("bigint").alias("n"), F.sha2("text", 256).alias("sha"))


def ch3_blocks(spark, d):
    return blocks(_docs(spark, d).select("doc_id", "text"), ["license", "the of"]).select("doc_id", F.col("block").cast("bigint").alias("block"), "kind", F.sha2("text", 256).alias("sha"))


def ch5_three_level(spark, d):
    return three_levels(_docs(spark, d).select("doc_id", F.concat(F.col("source"), F.lit("/"), F.col("doc_id")).alias("filename"), F.lit(1).alias("page"), "text"))


def ch10_namespace(spark, d):
    c = _docs(spark, d).select(F.concat(F.lit("c"), F.col("doc_id")).alias("chunk_id"), F.concat(F.lit("c"), F.floor(F.col("doc_id") * 3 / 2)).alias("parent_chunk_id"))
    return namespaced(c, F.lit("doc")).select("chunk_id", "parent_chunk_id")


def ch11_public_id(spark, d):
    return _docs(spark, d).select("source").distinct().select("source", public_id(F.concat(F.lit(" "), F.upper("source"))).alias("document_id"))


def tx6_html_sections(spark, d):
    sections = F.udf(lambda h: html_sections(h), "array<struct<n:int,text:string>>", useArrow=True)
    return read(spark, d, "pages").select("page_id", F.explode(sections("html")).alias("s")).select("page_id", "s.n", "s.text")


def rt12_hash_embedding(spark, d):
    return _docs(spark, d).select("doc_id", hash_embedding(F.col("text")).alias("embedding"))


QUERIES = {f.__name__: f for f in (ch3_blocks, ch5_three_level, ch7_window_split, ch10_namespace, ch11_public_id, tx6_html_sections, rt12_hash_embedding)}
SQL = {
    "ch7_window_split": "SELECT doc_id, i AS chunk, length(substr(text, i * 1080 + 1, 1200)) AS n, sha256(substr(text, i * 1080 + 1, 1200)) AS sha FROM documents, unnest(range(0, greatest(ceil((length(text) - 1200) / 1080.0), 0)::BIGINT + 1)) AS t(i) WHERE trim(text) <> ''",
    "ch3_blocks": r"""
        WITH l AS (SELECT doc_id, n - 1 AS n, trim(x[n]) AS s, rtrim(x[n]) AS r FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents), unnest(range(1, len(x) + 1)) AS t(n)),
        k AS (SELECT *, regexp_replace(s, '\s+', ' ', 'g') AS f FROM l),
        c AS (SELECT *, CASE WHEN s = '' THEN 'blank'
            WHEN regexp_matches(f, '^(#{1,6}\s+|([0-9]+)([.．、][0-9]+)*[.．、]\s*)\S+') OR trim(f, ':：') IN ('license', 'the of') OR (length(f) <= 36 AND NOT regexp_matches(f, '[。！？；，、,.!?;]$') AND (contains(f, 'license') OR contains(f, 'the of'))) THEN 'heading'
            WHEN length(s) - length(replace(s, '|', '')) >= 2 OR contains(s, chr(9)) OR regexp_matches(s, '\S\s{2,}\S\s{2,}\S') THEN 'table'
            WHEN regexp_matches(s, '^([0-9]+[.)、]|[-*•·])\s*\S+') THEN 'list' ELSE 'paragraph' END AS kind FROM k),
        b AS (SELECT *, CASE WHEN lag(kind) OVER w IS DISTINCT FROM kind OR kind IN ('heading', 'blank') THEN 1 ELSE 0 END AS new FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
        g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY n) AS g FROM b)
        SELECT doc_id, min(n) AS block, first(kind) AS kind, sha256(trim(string_agg(CASE WHEN kind = 'heading' THEN f ELSE r END, chr(10) ORDER BY n))) AS sha FROM g WHERE kind <> 'blank' GROUP BY doc_id, g""",
    "ch10_namespace": "WITH c AS (SELECT 'c' || doc_id AS id, 'c' || (doc_id * 3 // 2) AS p FROM documents) SELECT 'doc:' || left(sha256(c.id), 32) AS chunk_id, CASE WHEN o.id IS NULL THEN '' ELSE 'doc:' || left(sha256(c.p), 32) END AS parent_chunk_id FROM c LEFT JOIN (SELECT DISTINCT id FROM c) o ON c.p = o.id",
    "ch11_public_id": "SELECT DISTINCT source, 'public-' || left(sha256(lower(trim(' ' || upper(source)))), 40) AS document_id FROM documents",
}
