import random
import re

from pyspark.sql import functions as F

from ledgerloom.llm import url_filter

URLS = [
    (1, "http://A.Example.ORG/es/1"), (2, "https://example.org/en/12"), (3, "x://org"), (4, "x://org/"), (5, "http://my.com/fr/9?x=/de/"), (6, "http://com/de/"), (7, "http://xorg/en/"),
    (8, "no scheme"), (9, None), (10, ""), (11, "http://a://b/c"), (12, "http://É.org/É#frag"), (13, "ftp://telecom/de/1"), (None, "http://my.com/de/9"), (1, "http://A.Example.ORG/es/1"),
]


def brute(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1], m[2]) if m else ("", "")
    host = "".join(c.lower() if c.isascii() else c for c in host)
    best = ("", None, None)
    for verdict, rule in url_filter.RULES:
        rh, rp = rule[: rule.index("/")], rule[rule.index("/") :]
        if (host == rh or host.endswith("." + rh)) and path.startswith(rp) and len(rule) > len(best[0]):
            best = (rule, rule, verdict)
    return host, path, best[1], best[2]


def test_rules(spark):
    df = spark.createDataFrame([(i, u, 0) for i, u in URLS], "page_id long, url string, host int")
    labels = spark.createDataFrame([], "id long, bad int")
    rows = url_filter.url_filter(df, labels).collect()
    assert len(rows) == len(URLS)
    want = sorted(str((i, *brute(u)[:3], brute(u)[3] or "allow")) for i, u in URLS)
    assert sorted(str((r.page_id, r.host, r.path, r.rule, r.verdict)) for r in rows) == want
    assert url_filter.url_filter(df.limit(0), labels).count() == 0


def test_templates(spark):
    """A branch that differs stays and is rejected; the others are merged."""
    pages = spark.range(4000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h.net/"), F.when(F.col("id") % 4 == 0, "bad").when(F.col("id") % 4 == 1, "one").otherwise("two"), F.lit("/"), F.col("id")).alias("url"))
    labels = pages.select("page_id", ((F.col("page_id") % 4 == 0) | (F.col("page_id") % 20 == 1)).alias("bad")).where("page_id % 3 = 0")
    got = {(r.template, r.verdict) for r in url_filter.url_filter(pages, labels).select("template", "verdict").distinct().collect()}
    assert ("/bad/{n}", "block") in got and len([v for _, v in got if v == "block"]) == 1


def plain_templates(pages):
    """(host, path) -> (template, rejected), by the method of the module's head on plain dictionaries."""
    raw = {}
    for host, path, bad in pages:
        parts = re.sub("[0-9]+", "{n}", path).split("/")
        parts = parts[: url_filter.DEPTH + 1] + ["**"] * (len(parts) > url_filter.DEPTH + 1)
        k = raw.setdefault((host, path), [host, "/".join(parts), 0, 0])
        k[2] += bad is not None
        k[3] += bool(bad)
    names = {(h, r): r for h, r, _, _ in raw.values()}
    for level in range(max(r.count("/") for _, r in names), 0, -1):
        nodes = {}
        for h, r, m, b in raw.values():
            t = names[h, r].split("/")
            if len(t) > level:
                star = "/".join("*" if i == level else s for i, s in enumerate(t))
                x = nodes.setdefault((h, star), {}).setdefault("/".join(t), [0, 0])
                x[0] += m
                x[1] += b
        to = {}
        for (h, star), branches in nodes.items():
            bins = {}
            for t, (m, b) in branches.items():
                if m >= url_filter.SUPPORT:
                    bins.setdefault(int(b * url_filter.BINS / m), []).append(t)
            kin, before = [], None
            for k in sorted(bins):
                m, b = (sum(branches[t][i] for t in bins[k]) for i in (0, 1))
                if before:
                    p = (b + before[1]) / (m + before[0])
                    apart = (b / m - before[1] / before[0]) ** 2 > url_filter.Z**2 * p * (1 - p) * (1 / m + 1 / before[0])
                if before is None or apart:
                    kin.append([])
                kin[-1] += bins[k]
                before = (m, b)
            for i, ts in enumerate(kin):
                for t in ts:
                    name = "*" if len(kin) == 1 else f"*{i}"
                    to[h, t] = t if len(ts) == 1 else "/".join(name if j == level else s for j, s in enumerate(t.split("/")))
            for t, (m, _) in branches.items():
                if m < url_filter.SUPPORT:
                    to[h, t] = star
        names = {(h, r): to.get((h, t), t) for (h, r), t in names.items()}
    sums = {}
    for h, r, m, b in raw.values():
        x = sums.setdefault((h, names[h, r]), [0, 0])
        x[0] += m
        x[1] += b
    prior = sum(x[1] for x in sums.values()) / sum(x[0] for x in sums.values())
    bad = {k: (b + url_filter.WEIGHT * prior) / (m + url_filter.WEIGHT) >= url_filter.REJECT for k, (m, b) in sums.items()}
    return {(h, p): (names[h, r], bad[h, names[h, r]]) for (h, p), (_, r, _, _) in raw.items()}


def test_deep_paths_against_plain_version(spark):
    rnd = random.Random(17)
    rows = []
    for i in range(6000):
        host = rnd.choice(["a.net", "a.net", "b.net"])
        one, two = rnd.choice(["x", "y", "z"]), rnd.choice(["u", "v", "w", "t"])
        path = f"/{one}/{two}/slug-{rnd.choice('abcdefgh')}{'/deep' * rnd.choice([0, 1, 20])}/{i}"
        rate = {"x": 0.05, "y": 0.9, "z": 0.5 if two in "uv" else 0.02}[one]
        rows.append((i, f"http://{host}{path}", host, path, rnd.random() < rate if rnd.random() < 0.7 else None))
    pages = spark.createDataFrame([(i, u, 1) for i, u, *_ in rows], "page_id long, url string, raw int")
    labels = spark.createDataFrame([(i, b) for i, *_, b in rows if b is not None] + [(0, None)], "id long, bad boolean")
    want = plain_templates([(h, p, b) for _, _, h, p, b in rows])
    got = {(r.host, r.path): (r.template, r.verdict == "block") for r in url_filter.url_filter(pages, labels, rules=[]).collect()}
    assert got == want and len({t for t, _ in want.values()}) > 4 and any(b for _, b in want.values())
