"""Near deduplication: fast similarity sketching, banding, and verification on full shingle sets.

Texts with equal shingle sets are one node. Each node has a sketch, cut into bands; their number and width follow from the
threshold (`banding`), so that two sets just as similar share no band with a chance below MISSED.

Links are verified without emitting all pairs of a bucket. First every member is
compared with the bucket's hub, its least id, and components are formed. Buckets of more than
two members that still hold several components are open. Open buckets with very many members outside their largest
component are replaced by finer ones that lose no pair: a member is in the bucket of each shingle of its prefix, the
rarest ones of its set, so many that two sets above the threshold have one of them in common. Only those with several components
count, and their members are compared with the new hubs. What is
still open is cut into parts: those of the largest component, and those of all others. Each part of the others meets
each part, in a task that compares full sets and emits only the links that join components. Parts of the largest component
don't meet each other, so a large group of copies with some stragglers is sent once for each part of stragglers.
No task gets more than two parts, however large a bucket is; pairs whose links would change nothing are not emitted.

Pairs with a hub of which the sketches agree in too few coordinates are
dropped before verification: at the threshold the chance is below UNLIKE.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import fresh, release, small_batches, written
from ledgerloom.llm.components import components
from ledgerloom.llm.shingles import band_keys, chunks, shingle_sets, sketches

WORDS = 5
PERCENT = 85
#: Chances that a pair at the threshold shares no band, and that its sketches look unlike.
MISSED, UNLIKE = 1e-6, 1e-10
#: Most coordinates of a sketch.
COORDINATES = 128
#: Most rows and shingles of one part of a bucket; parts meet in pairs.
PART_ROWS, PART_SHINGLES = 512, 400_000
#: Parts of others in an open bucket from which it is replaced by buckets of prefixes.
AGAIN = 5
#: Slots in which the shingles of such buckets are counted, for an order that has rare ones first; a power of two.
SLOTS = 1 << 18
#: Copies of a set's class, so that the rows of a hot set meet it in several tasks.
SALTS = 16


def banding(percent: int) -> tuple[int, int, int]:
    """(bands, rows, least): the widest bands for which MISSED holds within COORDINATES, and the coordinates of the sketch that must agree."""
    p = percent / 100
    for rows in range(COORDINATES, 0, -1):
        bands = 1 if p >= 1 else math.ceil(math.log(MISSED) / math.log1p(-(p**rows)))
        if bands * rows <= COORDINATES:
            break
    else:
        raise ValueError(f"a similarity of {percent} percent needs more than {COORDINATES} coordinates")
    n, below, least = bands * rows, 0.0, 0
    while least < n and (below := below + math.comb(n, least) * p**least * (1 - p) ** (n - least)) < UNLIKE:
        least += 1
    return bands, rows, least


def _sketched(docs: DataFrame, words: int, bands: int, width: int) -> DataFrame:
    """id, n, set (digest of the shingle set, null if empty), bands, short (two bytes of each coordinate)."""
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("set", pa.string()), ("bands", pa.list_(pa.int64())), ("short", pa.binary())])

    def run(batches):
        release()
        for b in batches:
            ids, texts = b.column(0).cast(pa.int64()), b.column(1).to_pylist()
            for i, j in chunks(texts):
                off, h = shingle_sets(texts[i:j], words)
                s = sketches(off, h, bands * width)
                keys = band_keys(s, bands, width).view(np.int64)
                short = (s ^ (s >> np.uint64(48))).astype(np.uint16)
                n = np.diff(off)
                digest = [hashlib.blake2b(h[off[k] : off[k + 1]].tobytes(), digest_size=16).hexdigest() if n[k] else None for k in range(j - i)]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (j - i + 1) * bands, bands, dtype=np.int32)), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(n), pa.array(digest, pa.string()), lists, pa.array([r.tobytes() for r in short], pa.binary())], schema=schema)
        release()

    return docs.mapInArrow(run, "id long, n long, set string, bands array<long>, short binary")


def _sets(docs: DataFrame, words: int) -> DataFrame:
    schema = pa.schema([("id", pa.int64()), ("items", pa.binary())])

    def run(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            for i, j in chunks(texts):
                off, h = shingle_sets(texts[i:j], words)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i).cast(pa.int64()), pa.array([h[off[k] : off[k + 1]].tobytes() for k in range(j - i)], pa.binary())], schema=schema)
        release()

    return docs.mapInArrow(run, "id long, items binary")


def _slots(x: np.ndarray) -> np.ndarray:
    return ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)


def _levels(sets: DataFrame) -> np.ndarray:
    """How often the shingles of each slot are in `sets`, as powers of two; SLOTS bytes, whatever the size of `sets`."""

    def run(batches):
        n = np.zeros(SLOTS, np.int64)
        for b in batches:
            for x in b.column("items"):
                np.add.at(n, _slots(np.frombuffer(x.as_buffer(), np.uint64)), 1)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["slot", "n"])
        release()

    sums = sets.select("items").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    out = np.zeros(SLOTS, np.uint8)
    for r in sums.select("slot", F.floor(F.log2(F.col("n").cast("double"))).cast("int").alias("n")).toLocalIterator():
        out[r["slot"]] = r["n"]
    return out


def _prefixes(sets: DataFrame, levels: np.ndarray, percent: int) -> DataFrame:
    """(key, id, n): the first shingles of each set in the order of their levels. Sets of which `percent` percent is common have one of them in common, whatever the order."""
    schema = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("n", pa.int64())])

    def run(batches):
        for b in batches:
            for i, x in zip(b.column("id").to_pylist(), b.column("items")):
                x = np.frombuffer(x.as_buffer(), np.uint64)
                first = x[np.argsort(levels[_slots(x)], kind="stable")[: len(x) + -percent * len(x) // 100 + 1]].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(first), pa.array(np.full(len(first), i)), pa.array(np.full(len(first), len(x)))], schema=schema)
        release()

    return sets.select("id", "items").mapInArrow(run, "key long, id long, n long")


def _alike(pairs: DataFrame, shorts: DataFrame, least: int) -> DataFrame:
    """Pairs whose sketches agree in at least `least` coordinates."""
    both = pairs.join(shorts.select(F.col("id").alias("a"), F.col("short").alias("x")), "a").join(shorts.select(F.col("id").alias("b"), F.col("short").alias("y")), "b")

    def run(batches):
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint16).reshape(b.num_rows, -1) for k in (2, 3))
                yield b.select([0, 1]).filter(pa.array((x == y).sum(1) >= least))

    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets are similar enough."""
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("items").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("items").alias("y")), "b")

    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                common = int((y[at] == x).sum())
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))
        release()

    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _forest(t: pa.Table, percent: int) -> pa.Table:
    """Links between different components among the rows (id, c, items) of a part of a bucket, only as many as join the components.

    Sizes of all intersections are a product of the incidence matrix, by blocks of the shingles that two rows have.
    """
    ids, c = t.column("id").to_numpy(), t.column("c").to_numpy()
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("items")]
    size = np.array([len(x) for x in sets])
    shingle, count = np.unique(np.concatenate(sets), return_counts=True)
    shingle = shingle[count > 1]
    common = np.zeros((len(ids), len(ids)), np.float32)
    for at in range(0, len(shingle), 4096):
        block = shingle[at : at + 4096]
        m = np.zeros((len(ids), len(block)), np.float32)
        for i, x in enumerate(sets):
            own = x[np.searchsorted(x, block[0]) : np.searchsorted(x, block[-1], "right")]
            place = np.searchsorted(block, own)
            m[i, place[block[place] == own]] = 1
        common += m @ m.T
    linked = (100 * common >= percent * (size[:, None] + size[None, :] - common)) & (c[:, None] != c[None, :])
    up = {x: x for x in c.tolist()}

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for i, k in zip(*np.nonzero(np.triu(linked, 1))):
        a, b = top(int(c[i])), top(int(c[k]))
        if a != b:
            up[max(a, b)] = min(a, b)
            out.append((int(ids[i]), int(ids[k])))
    return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})


def _hub_links(members: DataFrame, sizes: DataFrame, shorts: DataFrame, sets: DataFrame, percent: int, least: int) -> DataFrame:
    """Verified links of the members (id, n, hub) of buckets with their hubs."""
    close = lambda a, b: 100 * F.least(a, b) >= percent * F.greatest(a, b)  # noqa: E731  similar sets have similar sizes
    pairs = members.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b"), "n").distinct()
    pairs = pairs.join(sizes.select(F.col("id").alias("a"), F.col("n").alias("m")), "a").where(close(F.col("n"), F.col("m"))).select("a", "b")
    return written(_linked(written(_alike(pairs, shorts, least)), sets, percent))


def _open(members: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members with their component c, buckets that still hold several components with the size of their largest and of all others).

    One of two members is done, as its hub has been compared with the other. Both are written, so that Spark can split the joins of hot buckets.
    """
    named = written(members.select("key", "id", "n").join(groups, "id", "left").select("key", "id", "n", F.coalesce("component", "id").alias("c")))
    by_component = named.groupBy("key", "c").agg(F.count("*").alias("size"), F.sum("n").alias("total"))
    buckets = by_component.groupBy("key").agg(F.count("*").alias("components"), F.sum("size").alias("size"), F.sum("total").alias("total"), F.max(F.struct("size", "c", "total")).alias("most"))
    parts = lambda size, total: F.greatest(F.ceil(size / PART_ROWS), F.ceil(total / PART_SHINGLES)).cast("int")
    rest = parts(F.col("size") - F.col("most.size"), F.col("total") - F.col("most.total"))
    return named, written(buckets.where("components > 1 and size > 2").select("key", F.col("most.c").alias("largest"), parts(F.col("most.size"), F.col("most.total")).alias("large"), rest.alias("rest")))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row of `docs`.

    Texts without words have an empty set and are linked with nothing. Rows that share an id
    are one document with all their links; rows with a null id are linked with nothing, get a null component
    and are kept. Other columns are ignored; an empty table gives an empty result. Very long texts are hashed whole, as one set.
    """
    bands, width, least = banding(percent)
    small_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    base = written(_sketched(src, words, bands, width))
    with_set = base.where("set is not null and id is not null")
    classes = with_set.groupBy("set").agg(F.min("id").alias("rep"))
    reps = written(with_set.groupBy("set").agg(F.min("id").alias("id"), F.min_by("n", "id").alias("n"), F.min_by("bands", "id").alias("bands"), F.min_by("short", "id").alias("short")))
    entries = reps.select("id", "n", F.explode("bands").alias("key"))
    buckets = written(entries.groupBy("key").agg(F.min("id").alias("hub"), F.count("*").alias("size")).where("size > 1"))
    members = written(entries.join(buckets.hint("merge"), "key").select("key", "id", "n", "hub"))
    in_buckets = members.select("id").distinct()
    shorts = written(reps.select("id", "short").join(in_buckets, "id", "left_semi"))
    sets = written(_sets(src.join(in_buckets, "id", "left_semi"), words))
    sizes = members.select("id", "n").distinct()

    links = _hub_links(members, sizes, shorts, sets, percent, least)
    named, open_ = _open(members, written(components(links)))
    big = open_.where(F.col("rest") >= AGAIN)
    if big.limit(1).count():
        hard = written(named.join(big.select("key"), "key", "left_semi").select("id", "c").distinct())
        their = sets.join(hard, "id", "left_semi")
        rare = written(_prefixes(their, _levels(their), percent).join(hard, "id"))
        hubs = written(rare.groupBy("key").agg(F.min(F.struct("id", "c")).alias("hub"), F.min("c").alias("least"), F.max("c").alias("most")).where("least < most").select("key", "hub"))
        again = written(rare.join(hubs.hint("merge"), "key").select("key", "id", "n", "c", "hub"))
        apart = again.where("c <> hub.c").select("key", "id", "n", F.col("hub.id").alias("hub"))
        links = written(links.union(_hub_links(apart, sizes, shorts, sets, percent, least)))
        done = members.join(open_.where(F.col("rest") < AGAIN).select("key"), "key", "left_semi")
        named, open_ = _open(done.select("key", "id", "n").union(again.select("key", "id", "n")), written(components(links)))

    # each part of the others meets itself, the others behind it, and all parts of the largest component
    left = named.join(open_.hint("merge"), "key").withColumn("main", F.col("c") == F.col("largest"))
    left = left.withColumn("part", F.pmod(F.xxhash64("id"), F.when(F.col("main"), F.col("large")).otherwise(F.col("rest"))).cast("int"))
    others = F.sequence(F.lit(0), F.col("rest") - 1)
    mine = F.when(F.col("main"), F.transform(others, lambda o: F.struct(o.alias("lo"), (F.col("rest") + F.col("part")).alias("hi"))))
    mine = mine.otherwise(
        F.concat(
            F.transform(others, lambda o: F.struct(F.least(o, F.col("part")).alias("lo"), F.greatest(o, F.col("part")).alias("hi"))),
            F.transform(F.sequence(F.lit(0), F.col("large") - 1), lambda o: F.struct(F.col("part").alias("lo"), (F.col("rest") + o).alias("hi"))),
        )
    )
    placed = left.select("key", "id", "c", F.explode(mine).alias("at")).select("key", "id", "c", "at.lo", "at.hi")
    last = placed.join(sets, "id").groupBy("key", "lo", "hi").applyInArrow(lambda t: _forest(t, percent), "a long, b long")
    salted = classes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("set", "s")
    copies = with_set.select(F.col("id").alias("b"), "set").join(salted, (F.col("set") == F.col("s")) & (F.pmod(F.xxhash64("b"), F.lit(SALTS)) == F.col("salt")))
    copies = copies.where("rep <> b").select(F.col("rep").alias("a"), "b")
    all_groups = written(components(links.union(last).union(copies)))
    got = base.select("id", "n").join(all_groups.withColumnRenamed("id", "node"), F.col("id") == F.col("node"), "left")
    component = F.coalesce("component", "id")
    return got.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """`docs` with one document of each group, that with the least id; rows with null ids stay. All rows and columns of a kept id stay as they are."""
    gone = fresh(docs, "gone")[0]
    lost = near_groups(docs, id_col, text_col, words, percent).where("not kept").select(F.col(id_col).alias(gone))
    return docs.join(lost, F.col(id_col) == F.col(gone), "left_anti")


def op3_near_dedup(spark, sf_dir):
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL: dict[str, str] = {}
QUERIES = {"op3_near_dedup": op3_near_dedup}
