"""URL filtering: allow and block rules first, then a path-template tree for each host. DataFrame functions only.

Templates: digits in a path become `{n}`, and what lies deeper than DEPTH segments becomes `**`. Level by level, from the deepest that occurs, the
branches of a node (one host, one template but for one segment) are compared: those with enough labelled pages are put in order by their
share of bad pages, in BINS steps, and neighbours that don't differ significantly are similar. Similar branches are merged into a wildcard: `*` if all of a
node are, else `*0`, `*1` and so on by rising share; a branch that is like no other stays. Branches with too few labelled pages to tell are merged into `*`.
A template is rejected when its share of bad labelled pages,
smoothed towards the share of all pages, reaches a threshold.

All steps work on counts by host and template, which are written once for each level; a node has at most BINS + 1 rows where its order matters. Pages are shuffled only
to be counted (with partial sums first) and, if the verdicts are too many to broadcast by Spark's own threshold, to get their template's verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import ascii_lower, written

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
#: Segments of a path that are kept apart; those behind them are one.
DEPTH = 16
#: A branch with fewer labelled pages can't be told from others.
SUPPORT = 20
#: Standard errors by which neighbours must differ.
Z = 3.0
#: Steps of the share of bad pages by which branches are put in order.
BINS = 50
#: Weight, in pages, of the share of all pages.
WEIGHT = 10.0
#: Smoothed share of bad pages from which a template is rejected.
REJECT = 0.4


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits a host and a path, or null. For short lists of rules: each is a condition of the plan."""
    out = None
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        at = rule.index("/")
        fits = ((host == rule[:at]) | host.endswith("." + rule[:at])) & path.startswith(rule[at:])
        got = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, got) if out is None else out.when(fits, got)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def raw_template(path: Column) -> Column:
    parts = F.split(F.regexp_replace(path, "[0-9]+", "{n}"), "/")
    return F.array_join(F.when(F.size(parts) > DEPTH + 1, F.concat(F.slice(parts, 1, DEPTH + 1), F.array(F.lit("**")))).otherwise(parts), "/")


def _merge_level(counts: DataFrame, level: int, support: int, z: float) -> DataFrame:
    """counts: host, raw, template, labelled, bad. Replaces segment `level` of templates by a wildcard where branches are similar."""
    parts = F.split("template", "/")
    with_ = lambda name: F.array_join(F.transform(parts, lambda s, i: F.when(i == level, name).otherwise(s)), "/")
    branches = counts.groupBy("host", "template").agg(F.sum("labelled").alias("m"), F.sum("bad").alias("b")).where(F.size(parts) > level)
    branches = branches.withColumn("star", with_(F.lit("*"))).withColumn("bin", F.when(F.col("m") >= support, F.floor(F.col("b") * BINS / F.col("m"))).cast("int"))
    steps = branches.where("bin is not null").groupBy("host", "star", "bin").agg(F.sum("m").alias("m"), F.sum("b").alias("b"), F.count("*").alias("n"))
    node = Window.partitionBy("host", "star").orderBy("bin")
    m, b = F.lag("m").over(node), F.lag("b").over(node)
    gap, share = F.col("b") / F.col("m") - b / m, (F.col("b") + b) / (F.col("m") + m)
    apart = F.coalesce(gap * gap > F.lit(z * z) * share * (1 - share) * (1 / F.col("m") + 1 / m), F.lit(False))
    steps = steps.withColumn("apart", apart.cast("int")).withColumn("kin", F.sum("apart").over(node))
    kin = Window.partitionBy("host", "star", "kin")
    steps = steps.withColumn("members", F.sum("n").over(kin)).withColumn("last", F.max("kin").over(Window.partitionBy("host", "star")))
    to = branches.join(steps.select("host", "star", "bin", "kin", "members", "last"), ["host", "star", "bin"], "left")
    wild = F.when(F.col("kin").isNull() | (F.col("last") == 0) & (F.col("members") > 1), F.col("star")).when(F.col("members") > 1, with_(F.concat(F.lit("*"), F.col("kin").cast("string")))).otherwise(F.col("template"))
    to = to.select("host", "template", wild.alias("merged"))
    return counts.join(to, ["host", "template"], "left").select("host", "raw", F.coalesce("merged", "template").alias("template"), "labelled", "bad")


def templates(pages: DataFrame, support: int = SUPPORT, z: float = Z, weight: float = WEIGHT, reject: float = REJECT) -> DataFrame:
    """(host, raw, template, purity, rejected) for each host and raw template of `pages` (host, raw, bad); bad is null where a page has no label."""
    counts = written(pages.groupBy("host", "raw").agg(F.count("bad").cast("double").alias("labelled"), F.coalesce(F.sum(F.col("bad").cast("double")), F.lit(0.0)).alias("bad")))
    total = counts.agg(F.sum("labelled").alias("m"), F.sum("bad").alias("b"), F.max(F.size(F.split("raw", "/"))).alias("depth")).first()
    prior = (total["b"] or 0) / total["m"] if total["m"] else 0.0
    counts = counts.withColumn("template", F.col("raw"))
    for level in range((total["depth"] or 1) - 1, 0, -1):  # DEPTH + 1 at most
        counts = written(_merge_level(counts, level, support, z))
    sums = counts.groupBy("host", "template").agg(F.sum("labelled").alias("m"), F.sum("bad").alias("b"))
    purity = (F.col("b") + F.lit(weight * prior)) / (F.col("m") + F.lit(weight))
    return counts.join(sums, ["host", "template"]).select("host", "raw", "template", purity.alias("purity"), (purity >= reject).alias("rejected"))


def url_filter(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, template) for each row of `pages`.

    `labels` has (id, bad) for some rows; an id with several labels is bad if one says so. Rows with null
    ids or urls, and urls without `://`, are judged like others with an empty host
    and path. Very long urls are judged whole; their templates end at DEPTH segments. Without labels, no template is rejected. Repeated rows are judged
    each; an empty table gives an empty result. Other columns are ignored.
    """
    at = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("id"), host_of(at).alias("host"), path_of(at).alias("path")).withColumn("raw", raw_template(F.col("path")))
    known = labels.select(F.col(labels.columns[0]).alias("id"), F.col(labels.columns[1]).cast("boolean").alias("bad")).groupBy("id").agg(F.max("bad").alias("bad"))
    verdicts = written(templates(rows.join(known, "id", "left")))
    out = rows.join(verdicts, ["host", "raw"], "left").withColumn("got", rule_of(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("got.verdict"), F.when(F.col("rejected"), F.lit("block")).otherwise(F.lit("allow")))
    return out.select(F.col("id").alias(id_col), "host", "path", F.col("got.rule").alias("rule"), verdict.alias("verdict"), "template")


def page_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(page_id, bad): a page's url ends with the number of the document that it shows; the document's label counts for it."""
    number = F.regexp_extract(path_of(F.col("url")), "/([0-9]{1,18})[^/]*/?$", 1)
    shown = pages.select("page_id", F.when(number != "", number).cast("bigint").alias("doc_id"))
    bad = labels.groupBy("doc_id").agg(F.max(((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")).alias("bad"))
    return shown.join(bad, "doc_id").groupBy("page_id").agg(F.max("bad").alias("bad"))


def op2_url_filter(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return url_filter(pages, page_labels(pages, labels))


#: Levels that the SQL spells out: as many as the paths of the tables have, and more.
_SQL_LEVELS = 4


def _sql_level(src: str, k: int) -> str:
    put = lambda name: f"array_to_string(list_transform(string_split(template, '/'), lambda s, i: CASE WHEN i = {k + 1} THEN {name} ELSE s END), '/')"
    return f"""
        br{k} AS (SELECT host, template, {put("'*'")} AS star, sum(labelled) AS m, sum(bad) AS b, CASE WHEN sum(labelled) >= {SUPPORT} THEN floor(sum(bad) * {BINS} / sum(labelled)) END AS bin
                  FROM {src} WHERE len(string_split(template, '/')) > {k} GROUP BY ALL),
        st{k} AS (SELECT host, star, bin, sum(m) AS m, sum(b) AS b, count(*) AS n FROM br{k} WHERE bin IS NOT NULL GROUP BY ALL),
        ap{k} AS (SELECT *, lag(m) OVER w AS m0, lag(b) OVER w AS b0 FROM st{k} WINDOW w AS (PARTITION BY host, star ORDER BY bin)),
        ki{k} AS (SELECT *, sum(CASE WHEN (b / m - b0 / m0) * (b / m - b0 / m0) > {Z * Z}::DOUBLE * ((b + b0) / (m + m0)) * (1 - (b + b0) / (m + m0)) * (1 / m + 1 / m0) THEN 1 ELSE 0 END) OVER (PARTITION BY host, star ORDER BY bin)::BIGINT AS kin FROM ap{k}),
        me{k} AS (SELECT *, sum(n) OVER (PARTITION BY host, star, kin) AS members, max(kin) OVER (PARTITION BY host, star) AS last FROM ki{k}),
        to{k} AS (SELECT br.host, template, CASE WHEN kin IS NULL OR last = 0 AND members > 1 THEN br.star WHEN members > 1 THEN {put("'*' || kin")} ELSE template END AS merged
                  FROM br{k} br LEFT JOIN me{k} me ON br.host = me.host AND br.star = me.star AND br.bin = me.bin),
        lv{k} AS (SELECT s.host, raw, coalesce(merged, s.template) AS template, labelled, bad FROM {src} s LEFT JOIN to{k} t ON s.host = t.host AND s.template = t.template),"""


def _sql() -> str:
    cases = " ".join(
        f"WHEN (host = '{r[: r.index('/')]}' OR suffix(host, '.{r[: r.index('/')]}')) AND starts_with(path, '{r[r.index('/') :]}') THEN '{{0}}'".replace("{0}", "{" + str(i) + "}")
        for i, (_, r) in enumerate(sorted(RULES, key=lambda x: -len(x[1])))
    )
    ordered = sorted(RULES, key=lambda x: -len(x[1]))
    rule = "CASE " + cases.format(*[r for _, r in ordered]) + " END"
    verdict = "CASE " + cases.format(*[v for v, _ in ordered]) + " END"
    return f"""
        WITH p AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                          coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
        r AS (SELECT *, regexp_replace(path, '[0-9]+', '{{n}}', 'g') AS raw, try_cast(regexp_extract(path, '/([0-9]{{1,18}})[^/]*/?$', 1) AS BIGINT) AS doc FROM p),
        d AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
        l AS (SELECT r.page_id, max(bad) AS bad FROM r JOIN d ON r.doc = d.doc_id GROUP BY r.page_id),
        c AS (SELECT host, raw, raw AS template, count(bad)::DOUBLE AS labelled, coalesce(sum(bad), 0)::DOUBLE AS bad FROM r LEFT JOIN l USING (page_id) GROUP BY ALL),
        {"".join(_sql_level("c" if k == _SQL_LEVELS else f"lv{k + 1}", k) for k in range(_SQL_LEVELS, 0, -1))}
        t AS (SELECT host, template, sum(labelled) AS m, sum(bad) AS b FROM lv1 GROUP BY ALL),
        g AS (SELECT coalesce(sum(bad) / nullif(sum(labelled), 0), 0) AS prior FROM c),
        v AS (SELECT host, raw, template, (b + {WEIGHT} * prior) / (m + {WEIGHT}) >= {REJECT} AS rejected FROM lv1 JOIN t USING (host, template), g)
        SELECT page_id, host, path, {rule} AS rule, coalesce({verdict}, CASE WHEN rejected THEN 'block' ELSE 'allow' END) AS verdict, template
        FROM r LEFT JOIN v USING (host, raw)
    """


SQL = {"op2_url_filter": _sql()}
QUERIES = {"op2_url_filter": op2_url_filter}
