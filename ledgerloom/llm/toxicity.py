"""Toxicity by maximum-scoring segments of token log-odds.

Fitting: counts of the toxic and other labelled texts with a token are smoothed with an informative
Dirichlet prior (pseudo-counts in proportion to a token's count in both), which gives each token a
log-odds and a z-score. Tokens that stand out make a lexicon; every other token
gets the log-odds of the remaining mass, a small negative number.

Scoring: one linear scan finds all maximal scoring segments (Ruzzo and Tompa). Segment scores
are calibrated by extreme-value statistics: a Gumbel distribution of the best segment among
other texts, whose location grows with the logarithm of the length, gives the
probability of a segment as good by chance. A text's evidence is the sum of the surprise
of its significant segments, and a logistic function turns it into a score.

What is fitted is bounded: at most `max_train` labelled texts (those with the least hash
of the id, so it is the same choice in every run). Every text is scored whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import release, small_batches, written

MAX_TRAIN = 20_000
#: Pseudo-counts of the prior in each class, as a share of all counts.
PRIOR = 0.05
#: Lengths of the beginnings of words that are features too, written with a star.
STEMS = (4, 6)
Z_MIN = 3.5
#: Least log-odds of the lexicon: about seven times as frequent among toxic texts.
ODDS_MIN = 2.0
THRESHOLD = 0.7
TOKEN = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class Model:
    lexicon: dict[str, float]
    rest: float  # log-odds of any other token, negative
    location: float  # of the best segment of other texts, less the logarithm of their length
    scale: float
    weight: float
    bias: float


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


def features(word: str) -> list[str]:
    """The word and its beginnings, the most specific first."""
    return [word, *[word[:n] + "*" for n in reversed(STEMS) if len(word) >= n]]


def scored(words: list[str], lexicon: dict[str, float]) -> list[tuple[int, float]]:
    """(position, log-odds) of the words of which a feature is in the lexicon."""
    found = []
    get, (short, long) = lexicon.get, STEMS
    for i, w in enumerate(words):
        if (s := get(w)) is not None or (s := get(w[:long] + "*")) is not None or (s := get(w[:short] + "*")) is not None:
            found.append((i, s))
    return found


def segments(scores: list[tuple[int, float]], n: int, rest: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a sequence of n scores that are `rest` but at the given positions.

    Ruzzo and Tompa's scan: candidates are kept with the running totals at their ends
    (left, right); a new one is merged with the last one before whose left total is lower, as long as
    the right total there is lower as well. Each candidate keeps the place of that one, and those between have left totals that are
    no lower, so the search follows these places and the scan is linear. Positive scores only start candidates, so
    what lies between two listed positions only changes the running total.
    """
    out: list[list] = []  # start, end, left, right, place of the last one before whose left total is lower
    total, at = 0.0, 0
    for i, s in scores:
        total += rest * (i - at)
        at = i + 1
        before, total = total, total + s
        if s <= 0:
            continue
        start, left, j = i, before, len(out) - 1
        while True:
            while j >= 0 and out[j][2] >= left:
                j = out[j][4]
            if j < 0 or out[j][3] >= total:
                out.append([start, i + 1, left, total, j])
                break
            start, left, before_it = out[j][0], out[j][2], out[j][4]
            del out[j:]
            j = before_it
    return [(a, b, r - left) for a, b, left, r, _ in out]


def _surprise(model: Model, score: float, n: int) -> float:
    """-log10 of the chance that the best segment of a text of n tokens that isn't toxic is as good."""
    x = min(math.exp(-(score - math.log(max(n, 1)) - model.location) / model.scale), 700.0) if score < 700 else 0.0
    return min(-math.log10(-math.expm1(-x)), 300.0) if x > 1e-300 else 300.0


def evidence(model: Model, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
    """Sum of the surprise of all segments, and the segments that are significant alone."""
    words = tokens(text)
    found = segments(scored(words, model.lexicon), len(words), model.rest)
    told = [(a, b, _surprise(model, s, len(words))) for a, b, s in found]
    return sum(s for _, _, s in told), [x for x in told if x[2] >= 2]


def _logistic(model: Model, x: float) -> float:
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, model.weight * x + model.bias))))


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Model from docs (id, text) and labels (doc_id, toxic); rows without id or label are left out. Without both classes nothing is toxic.

    An id with several labels is toxic if one of them says so. Documents that share an id share its label, and equal texts of one id
    count once. Null texts are empty. The choice of ids depends on their hashes alone; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    chosen = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    named = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    train = written(named.join(F.broadcast(chosen), "doc_id").distinct().select("text", "toxic"))  # max_train rows of two numbers at most

    def count(batches):
        both = [Counter(), Counter()]
        for b in batches:
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                both[toxic == 1].update({f for w in set(tokens(text)) for f in features(w)})  # once for each text, so that no text outweighs the others by repeating itself
        words = list(both[0] | both[1])
        yield pa.RecordBatch.from_pydict({"w": words, "clean": [both[0][w] for w in words], "toxic": [both[1][w] for w in words]}, schema=pa.schema([("w", pa.string()), ("clean", pa.int64()), ("toxic", pa.int64())]))

    counts = train.mapInArrow(count, "w string, clean long, toxic long").groupBy("w").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counts = written(counts)
    total = counts.agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).first()
    if not total["clean"] or not total["toxic"]:
        return Model({}, -1.0, 0.0, 1.0, 0.0, -10.0)
    n0, n1 = float(total["clean"]), float(total["toxic"])
    prior = PRIOR * (n0 + n1)
    alpha = F.lit(PRIOR) * (F.col("clean") + F.col("toxic"))
    y0, y1 = F.col("clean") + alpha, F.col("toxic") + alpha
    odds = F.log(y1 / (F.lit(n1 + prior) - y1)) - F.log(y0 / (F.lit(n0 + prior) - y0))
    told = counts.select("w", "clean", "toxic", odds.alias("odds"), (odds / F.sqrt(1 / y1 + 1 / y0)).alias("z")).where((F.col("z") >= Z_MIN) & (F.col("odds") >= ODDS_MIN))
    top = told.collect()  # of the words of max_train texts
    mass0, mass1 = sum(r["clean"] for r in top) / (n0 + prior), sum(r["toxic"] for r in top) / (n1 + prior)
    rest = min(math.log((1 - mass1) / (1 - mass0)), -1e-4)
    lexicon = {r["w"]: r["odds"] for r in top}
    raw = Model(lexicon, rest, 0.0, 1.0, 1.0, 0.0)

    def best(batches):
        for b in batches:
            rows = []
            for text in b.column(0).to_pylist():
                words = tokens(text)
                found = segments(scored(words, lexicon), len(words), rest)
                rows.append(max((s for *_, s in found), default=0.0) - math.log(max(len(words), 1)))
            yield pa.RecordBatch.from_pydict({"x": rows}, schema=pa.schema([("x", pa.float64())]))

    chance = train.where("toxic <> 1").mapInArrow(best, "x double").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("deviation")).first()
    # moments of a Gumbel distribution; log-odds scores have a scale of one in theory, which is the least that is taken
    scale = max(1.0, (chance["deviation"] or 0.0) * math.sqrt(6) / math.pi)
    location = (chance["mean"] or 0.0) - 0.5772156649015329 * scale
    model = Model(lexicon, rest, location, scale, raw.weight, raw.bias)

    def told_by(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([round(min(evidence(model, t)[0], 50.0), 3) for t in b.column(0).to_pylist()], pa.float64()), b.column(1).cast(pa.int64())], names=["x", "toxic"])

    # the texts by their evidence in thousandths up to 50: 50,001 values and two labels at most
    seen = train.select("text", F.col("toxic").cast("bigint").alias("toxic")).mapInArrow(told_by, "x double, toxic long").groupBy("x", (F.col("toxic") == 1).alias("y")).agg(F.count("*").alias("n")).collect()
    x, y, n = (np.array([float(r[i]) for r in seen]) for i in range(3))
    a, b = 1.0, -1.0
    for _ in range(100):  # Newton's method with a small ridge, for separable data
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([(n * (p - y) * x).sum() + 0.01 * a, (n * (p - y)).sum() + 0.01 * b])
        w = n * p * (1 - p)
        h = np.array([[(w * x * x).sum() + 0.01, (w * x).sum()], [(w * x).sum(), w.sum() + 0.01]])
        d = np.linalg.solve(h, g)
        a, b = a - float(np.clip(d[0], -2, 2)), b - float(np.clip(d[1], -2, 2))
        if abs(d).max() < 1e-9:
            break
    return Model(lexicon, rest, location, scale, a, b)


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, score, predicted, passages) for each row: passages lists (start, end, surprise) in tokens of the significant segments.

    Null and empty texts have no evidence and get the score of that. Repeated rows are
    scored each, ids may be null, other columns are ignored.
    """
    schema = pa.schema([("id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32()), ("passages", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("surprise", pa.float64())])))])

    def run(batches):
        for b in batches:
            got = [evidence(model, t.as_py()) for t in b.column(1)]
            score = [_logistic(model, min(e, 50.0)) for e, _ in got]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()), pa.array(score, pa.float64()), pa.array([int(s >= threshold) for s in score], pa.int32()), pa.array([[dict(start=a, end=z, surprise=s) for a, z, s in p] for _, p in got], schema.field(3).type)],
                schema=schema,
            )

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = src.mapInArrow(run, "id long, score double, predicted int, passages array<struct<start:int,end:int,surprise:double>>")
    return out.withColumnRenamed("id", id_col)


def held_out(c: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(c).cast("string")) % 3 == 1, F.lit(False))


def detoxify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` without the texts that are scored as toxic; learnt from the labels outside the held-out third.

    All columns stay as they are, whatever their names. Null and empty texts are judged as empty, repeated rows each alike, rows with null
    ids like others; an empty table stays empty.
    """
    model = fit(docs, labels.where(~held_out()), id_col=id_col, text_col=text_col)
    text = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            keep = [_logistic(model, min(evidence(model, t.as_py())[0], 50.0)) < threshold for t in b.column(text)]
            yield b.filter(pa.array(keep, pa.bool_()))
        release()

    return docs.mapInArrow(run, docs.schema)


def op9_toxicity(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = fit(docs, labels.where(~held_out()))
    return toxicity(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted", F.size("passages").alias("n_passages"))


SQL: dict[str, str] = {}
QUERIES = {"op9_toxicity": op9_toxicity}
