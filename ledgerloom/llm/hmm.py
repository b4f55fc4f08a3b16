"""Language-model scoring with a hidden Markov model trained by Baum-Welch.

Words belong to classes: each of the `top` most frequent training words is a class of
its own, all others share `tail` classes by their first characters, so that words
never seen have a class too. A latent state emits a class, and a class emits a word in
proportion to its smoothed count, with one more word for all that are unknown: the
probabilities of all words sum to one.

Counts of words are exact and cover the corpus. Texts are dealt to blocks by a hash of
their id and text; each block asks for the counts of its distinct words, so that it is
block vocabularies that are shuffled, not tokens. The class sequences are
written once in the shared folder. Each Baum-Welch iteration is one job: tasks sum the expected counts of
their texts, and the sums over tasks, whose number is bounded by the model's size, go
to the driver, which holds the parameters.

Sequences are cut into segments of 64 tokens. The transfer matrices of all segments
of a batch are multiplied side by side, the segments of a text are chained, and
the scaled forward and backward recursions then run in all segments at once. So
long texts need no long loop, and the likelihood is exact.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import text_bytes, written

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: The token after the last word; no word is empty.
END = b""
SEGMENT = 64
#: Tokens of prior for the states of a class.
PULL = 5.0
BLOCK_BYTES = 8_000_000


def tokens(text: str | None) -> list[bytes]:
    """Words in UTF-8, split at the white space of ASCII, A-Z lower-cased, and END."""
    return [*(text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split(), END]


def hash64(s: bytes) -> int:
    h = 0xCBF29CE484222325
    for b in s:
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h ^ h >> 31


class Classes:
    """Class of each word: 0 .. top-1 for the frequent ones, top .. top+tail-1 for the others."""

    def __init__(self, frequent: list[bytes], tail: int):
        self.known = {w: i for i, w in enumerate(frequent)}
        self.top, self.tail, self.n = len(frequent), tail, len(frequent) + tail
        self.stems: dict[bytes, int] = {}

    def __call__(self, word: bytes) -> int:
        c = self.known.get(word)
        if c is None:
            stem = word[:3]
            c = self.stems.get(stem)
            if c is None:
                c = self.stems[stem] = self.top + hash64(stem) % self.tail
        return c


# numpy: recursions over segments


class _Segments:
    """Sequences cut into segments, sorted by falling length, so that those that reach a place are the first ones."""

    def __init__(self, classes: np.ndarray, lengths: np.ndarray):
        n = -(-lengths // SEGMENT)
        text = np.repeat(np.arange(len(lengths)), n)
        place = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
        first = np.repeat(np.cumsum(lengths) - lengths, n) + place * SEGMENT
        length = np.minimum(SEGMENT, np.repeat(lengths, n) - place * SEGMENT)
        order = np.argsort(-length, kind="stable")
        where = np.empty(len(order), np.int64)
        where[order] = np.arange(len(order))
        self.text, self.length, self.texts = text[order], length[order], len(lengths)
        self.head, self.tail = where[np.cumsum(n) - n], where[np.cumsum(n) - 1]
        self.last = np.zeros(len(order), bool)
        self.last[self.tail] = True
        # segments by their place in the text, and those before them
        by_place = np.argsort(place, kind="stable")
        cut = np.r_[0, np.cumsum(np.bincount(place))]
        self.steps = [(where[by_place[a:b]], where[by_place[a:b] - 1]) for a, b in zip(cut[1:-1], cut[2:])]
        self.x = classes[np.minimum(first[order][None, :] + np.arange(int(length.max()))[:, None], len(classes) - 1)]
        self.live = [int(np.searchsorted(-self.length, -t, "left")) for t in range(len(self.x))]  # segments longer than t


def _transfers(g: _Segments, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product over a segment's tokens of diag(emission) * transition, up to a factor. b: relative emissions, at most one."""
    k = len(a)
    m = np.broadcast_to(np.eye(k), (len(g.text), k, k)).copy()
    for t, n in enumerate(g.live):
        step = m[:n] * b[g.x[t, :n]][:, None, :]
        m[:n] = (step.reshape(-1, k) @ a).reshape(n, k, k)
        if t % 16 == 15:
            m[:n] /= m[:n].sum((1, 2), keepdims=True)
    return m


def _chain(g: _Segments, m: np.ndarray, pi: np.ndarray) -> np.ndarray:
    """State distribution before each segment."""
    start = np.broadcast_to(pi, (len(g.text), len(pi))).copy()
    for now, before in g.steps:
        v = np.einsum("si,sij->sj", start[before], m[before])
        start[now] = v / v.sum(1, keepdims=True)
    return start


def _chain_back(g: _Segments, m: np.ndarray) -> np.ndarray:
    """Backward message after each segment, scaled."""
    end = np.ones((len(g.text), m.shape[1]))
    for after, now in reversed(g.steps):
        v = np.einsum("sij,sj->si", m[after], end[after])
        end[now] = v / v.sum(1, keepdims=True)
    return end


def log_likelihood(classes: np.ndarray, lengths: np.ndarray, pi: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Natural logarithm of the probability of each class sequence (none is empty). b: (classes, states)."""
    g = _Segments(classes, lengths)
    alpha = _chain(g, _transfers(g, a, b / b.max(1, keepdims=True)), pi)
    total = np.zeros(len(g.text))
    for t, n in enumerate(g.live):
        joint = alpha[:n] * b[g.x[t, :n]]
        scale = joint.sum(1)
        total[:n] += np.log(scale)
        alpha[:n] = joint / scale[:, None] @ a
    return np.bincount(g.text, total, g.texts)


def expected_counts(classes: np.ndarray, lengths: np.ndarray, pi: np.ndarray, a: np.ndarray, b: np.ndarray):
    """Baum-Welch statistics of a batch: first states, transitions, and emissions (classes, states)."""
    g = _Segments(classes, lengths)
    k, relative = len(a), b / b.max(1, keepdims=True)
    m = _transfers(g, a, relative)
    alpha, beta = _chain(g, m, pi), _chain_back(g, m)
    joints = np.empty((*g.x.shape, k))  # joint of state and token, scaled
    for t, n in enumerate(g.live):
        joint = alpha[:n] * relative[g.x[t, :n]]
        joint /= joint.sum(1, keepdims=True)
        joints[t, :n] = joint
        alpha[:n] = joint @ a
    gammas, moves = np.zeros((*g.x.shape, k)), np.zeros_like(a)
    for t in range(len(g.x) - 1, -1, -1):  # beta: message after token t, for the state before the next token
        n = g.live[t]
        gamma = joints[t, :n] * (beta[:n] @ a.T)
        scale = gamma.sum(1, keepdims=True)
        gammas[t, :n] = gamma / scale
        weight = joints[t, :n] / scale
        weight[g.last[:n] & (g.length[:n] == t + 1)] = 0  # no move after a text's last token
        moves += weight.T @ beta[:n]
        back = relative[g.x[t, :n]] * (beta[:n] @ a.T)
        beta[:n] = back / back.sum(1, keepdims=True)
    used = np.arange(len(g.x))[:, None] < g.length[None, :]
    x = g.x[used]
    emissions = np.stack([np.bincount(x, gammas[..., s][used], len(b)) for s in range(k)], 1)
    return gammas[0, g.head].sum(0), moves * a, emissions


def initial(states: int, classes: int, share: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fixed start: states prefer themselves, and each has its own half of the classes, by bits of a hash."""
    a = np.full((states, states), 0.2 / max(1, states - 1))
    np.fill_diagonal(a, 0.8 if states > 1 else 1.0)
    tilt = np.array([[1.5 if hash64(b"%d:%d" % (s, c)) >> 7 & 1 else 0.5 for s in range(states)] for c in range(classes)])
    b = share[:, None] * tilt
    return np.full(states, 1 / states), a, b / b.sum(0)


def _batches(batches, rows: int = 512):
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def _sequences(b: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray]:
    col = b.column(column)
    raw = col.to_pylist()
    return np.frombuffer(b"".join(raw), np.int32), np.array([len(r) // 4 for r in raw], np.int64)


def lm_scores(docs: DataFrame, held, id_col: str = "doc_id", text_col: str = "text", states: int = 4, top: int = 4096, tail: int = 2048, iterations: int = 4) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of `docs`; rows where the column `held` is true don't train.

    Null texts are empty: they have the end token alone. Rows with null ids are scored, and
    train unless held out; repeated rows count each. Without training rows all words are
    unknown. Very long texts are cut into segments. Other columns are ignored, whatever their names. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    blocks = max(1, math.ceil(text_bytes(docs, text_col) / BLOCK_BYTES))
    # the row's place in its block is not needed: a block's rows are scored as they come
    src = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), held.alias("held"))
    src = src.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int"))

    def vocabulary(t: pa.Table) -> pa.Table:
        """The distinct words of a block, with their counts in its training texts."""
        count, seen = Counter(), set()
        for text, h in zip(t.column("text"), t.column("held").to_pylist()):
            (seen if h else count).update(tokens(text.as_py()))
        words = [*count, *(seen - count.keys())]
        return pa.table({"block": pa.array([t.column("block")[0].as_py()] * len(words), pa.int32()), "w": pa.array(words, pa.binary()).cast(pa.string()), "c": pa.array([*count.values(), *[0] * (len(words) - len(count))], pa.int64())})

    by_block = written(src.select("text", "held", "block").groupBy("block").applyInArrow(vocabulary, "block int, w string, c long"))
    counts = by_block.groupBy("w").agg(F.sum("c").alias("c"))
    stats = written(counts)
    total = stats.where("c > 0").agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n, v = int(total["n"] or 0), int(total["v"])
    frequent = [r["w"].encode() for r in stats.where("c > 0").orderBy(F.desc("c"), "w").limit(top).collect()]
    classes = Classes(frequent, tail)

    # weight of each class in words: sum of smoothed counts, and the unknown word in the class of END's stem
    def weigh(batches):
        sums = np.zeros(classes.n)
        for b in batches:
            np.add.at(sums, [classes(w) for w in b.column(0).cast(pa.binary()).to_pylist()], b.column(1).to_numpy() + 0.5)
        yield pa.RecordBatch.from_pydict({"k": np.arange(classes.n, dtype=np.int32), "s": sums})

    unknown = classes.top + hash64(b"unknown") % tail
    weight = np.zeros(classes.n)
    for r in stats.where("c > 0").mapInArrow(weigh, "k int, s double").groupBy("k").agg(F.sum("s").alias("s")).collect():  # one row for each class
        weight[r["k"]] = r["s"]
    weight[unknown] += 0.5

    # blocks and the counts of their words meet; a text becomes its classes and the sums of its words' log probabilities
    asked = by_block.select("block", "w").join(stats.withColumnRenamed("c", "total"), "w").where("total > 0").select("block", "w", "total")
    out_schema = pa.schema([("id", pa.int64()), ("held", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("within", pa.float64()), ("seq", pa.binary())])

    def encode(texts: pa.Table, words: pa.Table) -> pa.Table:
        norm = math.log10(n + 0.5 * (v + 1))
        known = words.column("w").cast(pa.binary()).to_pylist()
        count = np.r_[0.0, words.column("total").to_numpy().astype(float)]  # the first place is the unknown word's
        place = {w: i for i, w in enumerate(known, 1)}
        kinds = np.array([unknown, *map(classes, known)], np.int32)
        base, within = np.log10(count + 0.5) - norm, np.log10((count + 0.5) / weight[kinds])
        get, rows = place.get, []
        for id_, text, h in zip(texts.column("id").to_pylist(), texts.column("text"), texts.column("held").to_pylist()):
            at = np.array([get(w, 0) for w in tokens(text.as_py())])
            rows.append((id_, h, len(at), int((at > 0).sum()), float(base[at].sum()), float(within[at].sum()), kinds[at].tobytes()))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 7, out_schema)], schema=out_schema)

    encoded = src.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(encode, "id long, held boolean, n_tokens long, n_known long, base double, within double, seq binary")
    encoded = written(encoded)

    pi, a, b = initial(states, classes.n, weight / weight.sum())
    for _ in range(iterations if n else 0):
        params = spark.sparkContext.broadcast((pi, a, b))  # states * classes numbers

        def expect(batches, params=params):
            p = params.value
            sums = [np.zeros_like(p[0]), np.zeros_like(p[1]), np.zeros_like(p[2])]
            for part in _batches(batches):
                x, lengths = _sequences(part, 0)
                if len(lengths):
                    for s, got in zip(sums, expected_counts(x, lengths, *p)):
                        s += got
            flat = np.concatenate([s.ravel() for s in sums])
            yield pa.RecordBatch.from_pydict({"i": np.arange(len(flat), dtype=np.int32), "x": flat})

        got = encoded.where("not held").select("seq").mapInArrow(expect, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).toPandas()  # one row for each parameter
        flat = np.zeros(states + states * states + classes.n * states)
        flat[got["i"].to_numpy()] = got["x"].to_numpy()
        starts, moves, emissions = flat[:states], flat[states : states + states**2].reshape(states, states), flat[states + states**2 :].reshape(-1, states)
        pi = (starts + 1) / (starts + 1).sum()
        a = (moves + 1) / (moves + 1).sum(1, keepdims=True)
        # states of a class, drawn towards those of all classes by PULL tokens: a class seen once says little
        states_of = emissions + PULL * emissions.sum(0) / emissions.sum()
        b = weight[:, None] * states_of / states_of.sum(1, keepdims=True)
        b = b / b.sum(0)
    params = spark.sparkContext.broadcast((pi, a, b))

    def score(batches):
        schema = pa.schema([("id", pa.int64()), ("held", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())])
        for part in _batches(batches):
            x, lengths = _sequences(part, 6)
            got = log_likelihood(x, lengths, *params.value) / math.log(10) if len(lengths) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(5)), pa.array(got + part.column(5).to_numpy())], schema=schema)

    out = encoded.mapInArrow(score, "id long, held boolean, n_tokens long, n_known long, base double, score double")
    return out.select(F.col("id").alias(id_col), F.col("held").alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("bigint").alias("train_tokens"), F.col("base").alias("base_score"), "score")


def op7_language_model(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return lm_scores(docs, F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False)))


SQL: dict[str, str] = {}
QUERIES = {"op7_language_model": op7_language_model}
