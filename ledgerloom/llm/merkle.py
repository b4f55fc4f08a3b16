"""Merkle manifest of a dataset: a digest for each row, a tree for each group of rows, and a tree over the groups.

The rows of a group are put in order by range partitions and numbered by prefix sums of
the partitions' counts, so a group of any size is in many tasks. Aligned blocks of
numbered nodes are traversed alone: the recursion returns the digest of a subtree, and
appends to the path of each leaf below the siblings it meets while it unwinds. The roots
of the blocks are the nodes of the next traversal, until each group has one root; the
roots of the groups go through the same traversals once more. On the way back each
block gets the path above its root, so that its leaves have theirs up to the root.

A task holds one block at a time, whatever the sizes of the groups and their number.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import ascii_lower, table, written

#: Nodes of a run, and levels of a block: a block has ARITY**LEVELS nodes at most.
ARITY, LEVELS = 8, 4


def leaf_digest(*values: Column) -> Column:
    """Digest of values: each is its number of UTF-8 bytes, a colon and itself, or a dash if it is null."""
    text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]), 256)


def fold(leaf: Column, at: Column, siblings: Column) -> Column:
    """Root that a leaf and its stored path (places, joined siblings) give."""
    step = lambda h, x: F.sha2(F.concat(F.substring(x["s"], F.lit(1), 64 * x["p"]), h, F.substring(x["s"], 64 * x["p"] + 1, F.length(x["s"]))), 256)
    return F.aggregate(F.zip_with(at, siblings, lambda p, s: F.struct(p.alias("p"), s.alias("s"))), leaf, step)


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def height(n: int, most: int) -> int:
    """Levels that a block climbs if its group has n nodes: until one is left, or `most`."""
    out = 0
    while out < most and ARITY**out < n:
        out += 1
    return out


def traverse(nodes: list[str], first: int, levels: int, paths: list[list] | None) -> str:
    """Digest of the subtree of `levels` levels that begins at node `first`. Each node below gets (place, joined siblings) for each level, in `paths`."""
    if not levels:
        return nodes[first]
    width = ARITY ** (levels - 1)
    starts = range(first, min(first + ARITY * width, len(nodes)), width)
    kids = [traverse(nodes, s, levels - 1, paths) for s in starts]
    if paths is not None:
        for place, s in enumerate(starts):
            step = (place, "".join(kids[:place] + kids[place + 1 :]))
            for p in paths[s : s + width]:
                p.append(step)
    return _hash("".join(kids))


def _runs(batches):
    """Lists of the rows that share their first two columns; sorted rows come in."""
    rows: list[tuple] = []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if rows and row[:2] != rows[-1][:2]:
                yield rows
                rows = []
            rows.append(row)
    if rows:
        yield rows


def _numbered(nodes: DataFrame, order: list[str], deep: int) -> DataFrame:
    """nodes (g, ...) with `idx`, the number of a row in its group by `order` (nulls first), `total`, the group's size, and `block`.

    Equal rows are dealt to several range partitions by a last key, so no value fills one of them.
    """
    keys = [F.asc_nulls_first(c) for c in ["g", *order]] + [F.asc("tie")]
    dealt = nodes.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("tie")
    schema = ", ".join(f"{c} {t}" for c, t in dealt.dtypes)
    where = dealt.columns.index("g")

    def number(batches):
        last, count = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            g = b.column(where)
            code = g.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            begins = np.r_[0, np.nonzero(np.diff(code))[0] + 1]
            pos = np.arange(b.num_rows) - np.repeat(begins, np.diff(np.r_[begins, b.num_rows]))
            if last is not None and last[0] == g[0].as_py():
                pos[: begins[1] if len(begins) > 1 else b.num_rows] += count
            last, count = (g[-1].as_py(),), int(pos[-1]) + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pos)], names=[*b.schema.names, "pos"])

    dealt = written(dealt.mapInArrow(number, f"{schema}, pos long").withColumn("part", F.spark_partition_id()))
    counts = dealt.groupBy("part", "g").agg(F.count("*").alias("n"))
    group = Window.partitionBy("g")  # a row for each partition that has rows of the group
    counts = counts.select("part", F.col("g").alias("cg"), (F.sum("n").over(group.orderBy("part")) - F.col("n")).alias("before"), F.sum("n").over(group).alias("total"))
    placed = dealt.join(counts, (dealt["part"] == counts["part"]) & dealt["g"].eqNullSafe(counts["cg"])).drop("part", "cg")
    idx = F.col("before") + F.col("pos")
    return placed.withColumn("idx", idx).withColumn("block", F.floor(idx / ARITY**deep)).drop("before", "pos")


def _together(rows: DataFrame) -> DataFrame:
    """Rows (g, block, idx, ...) of a block in one task, in order."""
    return rows.repartition("g", "block").sortWithinPartitions("g", "block", "idx")


def _climb(placed: DataFrame, deep: int) -> tuple[list[DataFrame], DataFrame]:
    """Nodes of each traversal, beginning with `placed`, and (g, digest) of the groups' roots."""

    block = ARITY**deep

    def up(batches):
        for rows in _runs(batches):
            total = rows[0][3]
            root = traverse([r[4] for r in rows], 0, height(total, deep), None)
            yield pa.RecordBatch.from_pydict({"g": pa.array([rows[0][0]], pa.string()), "idx": [rows[0][1]], "total": [-(-total // block)], "digest": [root]})

    levels, most = [placed], placed.agg(F.max("total")).first()[0] or 0
    while True:
        src = levels[-1].select("g", "block", "idx", "total", "digest")
        roots = written(_together(src).mapInArrow(up, "g string, idx long, total long, digest string"))
        if most <= block:
            return levels, roots.select("g", "digest")
        levels.append(roots.withColumn("block", F.floor(F.col("idx") / block)))
        most = -(-most // block)


def _descend(nodes: DataFrame, above: DataFrame, body, schema: str, deep: int) -> DataFrame:
    """Each block of nodes with the path above it, (g, block, at, sib, sub), in body(nodes, paths, sub)."""
    names = ["g", "block", "idx", "total", "digest", "key", "claim"]
    kinds = dict(nodes.dtypes)
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    left = nodes.select("g", "block", "idx", "total", "digest", *[F.col(c) if c in kinds else none(c, "string") for c in names[5:]], none("at", "array<int>"), none("sib", "array<string>"), none("sub", "string"))
    right = above.select("g", "block", F.lit(-1).cast("bigint").alias("idx"), none("total", "bigint"), none("digest", "string"), *[none(c, kinds.get(c, "string")) for c in names[5:]], "at", "sib", "sub")

    def down(batches):
        for rows in _runs(batches):
            top, rows = rows[0], rows[1:]  # number -1 comes first
            nodes = [r[4] for r in rows]
            paths: list[list] = [[] for _ in rows]
            traverse(nodes, 0, height(rows[0][3], deep), paths)
            upper = list(zip(top[7], top[8]))
            for p in paths:
                p.extend(upper)
            yield from body(rows, paths, top[9])

    return _together(left.unionByName(right)).mapInArrow(down, schema)


PATHS = "g string, block long, key string, digest string, at array<int>, sib array<string>, sub string"


def _paths(rows, paths, sub):
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([r[0] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[5] for r in rows], pa.string()), pa.array([r[4] for r in rows], pa.string()),
            pa.array([[x[0] for x in p] for p in paths], pa.list_(pa.int32())), pa.array([[x[1] for x in p] for p in paths], pa.list_(pa.string())), pa.array([sub] * len(rows), pa.string()),
        ],
        names=["g", "block", "key", "digest", "at", "sib", "sub"],
    )


def _down_to_first(levels: list[DataFrame], above: DataFrame, deep: int) -> DataFrame:
    """(g, block, key, digest, at, sib, sub): the paths of the nodes that are the blocks of levels[0]."""
    for nodes in levels[:0:-1]:
        above = written(_descend(nodes, above, _paths, PATHS, deep))
    return above


def manifest(df: DataFrame, fields: list[str], group_col: str = "lang", id_col: str = "doc_id", claims: dict[str, Column] | None = None, proofs: bool = False, deep: int = LEVELS) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root) for each row, and with `proofs` the path itself: `at` (places) and `siblings` (joined).

    A leaf is the digest of `fields`; leaves of a group ascend by id, and groups by name, bytewise. `claims` are other
    values of fields: folded_root is what the leaf of the claimed values and the true siblings give, so it is the root
    exactly if the claimed row is the true one.

    Nulls: a null field has its own code; a null group is a group and the first one; rows with null ids come first in
    their group. Rows that share an id are ordered by leaf; equal rows are leaves of their own. Empty texts differ from
    nulls; very long ones are hashed where they are read and not shuffled. A group of one row is its own subroot, one
    group is the root; an empty table gives an empty result. Other columns are ignored, whatever their names. The trees are
    built when this is called, as tables in the shared folder; a block climbs `deep` levels.
    """
    col = lambda c: F.col(f"`{c}`")
    said = claims or {}
    claim = leaf_digest(*[said.get(c, col(c)) for c in fields]) if said else F.lit(None).cast("string")
    leaves = written(df.select(col(group_col).cast("string").alias("g"), col(id_col).alias("key"), leaf_digest(*[col(c) for c in fields]).alias("digest"), claim.alias("claim")))
    levels, subroots = _climb(_numbered(leaves, ["key", "digest"], deep), deep)
    groups = _numbered(subroots.select(F.lit("").alias("g"), F.col("g").alias("key"), "digest"), ["key"], deep)
    upper, top = _climb(groups, deep)
    root = top.first()
    root = root["digest"] if root else None
    none = F.array().cast("array<int>").alias("at"), F.array().cast("array<string>").alias("sib")
    first = top.select("g", F.lit(0).cast("bigint").alias("block"), *none, F.lit(None).cast("string").alias("sub"))
    # the paths of the groups are those of the first level's own nodes
    own = written(_descend(upper[0], _down_to_first(upper, first, deep), _paths, PATHS, deep))
    above = _down_to_first(levels, own.select(F.col("key").alias("g"), F.lit(0).cast("bigint").alias("block"), "at", "sib", F.col("digest").alias("sub")), deep)
    kind = dict(leaves.dtypes)["key"]
    more = ", at array<int>, siblings array<string>" if proofs else ""

    def rows_of(rows, paths, sub):
        folded = []
        for r, p in zip(rows, paths):
            h = r[4] if r[6] is None else r[6]
            for place, s in p:
                h = _hash(s[: 64 * place] + h + s[64 * place :])
            folded.append(h)
        out = [pa.array([r[5] for r in rows]), pa.array([r[4] for r in rows]), pa.array([sub] * len(rows)), pa.array([_hash("".join([x[1] for x in p])) for p in paths]), pa.array(folded)]
        if proofs:
            out += [pa.array([[x[0] for x in p] for p in paths], pa.list_(pa.int32())), pa.array([[x[1] for x in p] for p in paths], pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays(out, names=["key", "leaf", "subroot", "proof_sha256", "folded_root", "at", "siblings"][: len(out)])

    out = _descend(levels[0], above, rows_of, f"key {kind}, leaf string, subroot string, proof_sha256 string, folded_root string{more}", deep)
    return out.select(F.col("key").alias(id_col), "leaf", "subroot", F.lit(root).alias("root"), "proof_sha256", "folded_root", *(["at", "siblings"] if proofs else []))


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def op13_merkle(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    out = manifest(docs, FIELDS, claims={"text": F.when(tampered, ascii_lower(F.col("text"))).otherwise(F.col("text"))})
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _sql(deep: int = 7, wide: int = 3) -> str:
    """The trees spelled out for up to 8**deep rows of a language and 8**wide languages."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    code = lambda x: f"coalesce(strlen({x}::VARCHAR)::VARCHAR || ':' || {x}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join(code(c) for c in ["doc_id", "source", "lang", "n_chars", text]) + ")"
    bits = "list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, w: xor(v >> 1, 3988292384 * (v & 1)))"
    crc = f"xor(4294967295::BIGINT, list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT), lambda a, b: {bits}))"
    parts = [
        f"s AS (SELECT doc_id, lang, {leaf('text')} AS leaf, CASE WHEN doc_id IS NOT NULL AND {crc} % 3 = 0 THEN {leaf(f'''translate(text, '{upper}', '{lower}')''')} ELSE {leaf('text')} END AS claim FROM documents)",
        "l0 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i0 FROM s)",
        "n0 AS (SELECT lang, i0 AS i, leaf AS d, count(*) OVER (PARTITION BY lang) AS n FROM l0)",
    ]
    for k in range(deep):  # what is alone stays as it is
        parts.append(f"n{k + 1} AS MATERIALIZED (SELECT lang, i // 8 AS i, CASE WHEN any_value(n) = 1 THEN any_value(d) ELSE sha256(string_agg(d, '' ORDER BY i)) END AS d, (any_value(n) + 7) // 8 AS n FROM n{k} GROUP BY lang, i // 8)")
    parts.append(f"g0 AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, d, count(*) OVER () AS n FROM n{deep})")
    for k in range(wide):
        parts.append(f"g{k + 1} AS MATERIALIZED (SELECT i // 8 AS i, CASE WHEN any_value(n) = 1 THEN any_value(d) ELSE sha256(string_agg(d, '' ORDER BY i)) END AS d, (any_value(n) + 7) // 8 AS n FROM g{k} GROUP BY i // 8)")
    for k in range(deep):
        parts.append(f"r{k} AS MATERIALIZED (SELECT lang, i // 8 AS b, list(d ORDER BY i) AS run, any_value(n) AS n FROM n{k} GROUP BY lang, i // 8)")
    for k in range(wide):
        parts.append(f"q{k} AS MATERIALIZED (SELECT i // 8 AS b, list(d ORDER BY i) AS run, any_value(n) AS n FROM g{k} GROUP BY i // 8)")
    step = lambda src, join, at: (
        f"SELECT x.* EXCLUDE (proof, fold), CASE WHEN r.n = 1 THEN x.proof ELSE x.proof || array_to_string(list_filter(r.run, lambda d, j: j <> {at} % 8 + 1), '') END AS proof, "
        f"CASE WHEN r.n = 1 THEN x.fold ELSE sha256(array_to_string(list_transform(r.run, lambda d, j: CASE WHEN j = {at} % 8 + 1 THEN x.fold ELSE d END), '')) END AS fold FROM {src} x JOIN {join}"
    )
    parts.append("p0 AS (SELECT *, '' AS proof, claim AS fold FROM l0)")
    for k in range(deep):
        at = f"(x.i0 // {8**k})"
        parts.append(f"p{k + 1} AS MATERIALIZED ({step(f'p{k}', f'r{k} r ON r.lang IS NOT DISTINCT FROM x.lang AND r.b = x.i0 // {8 ** (k + 1)}', at)})")
    parts.append(f"u0 AS (SELECT x.*, g.i AS gi, g.d AS subroot FROM p{deep} x JOIN g0 g ON g.lang IS NOT DISTINCT FROM x.lang)")
    for k in range(wide):
        parts.append(f"u{k + 1} AS MATERIALIZED ({step(f'u{k}', f'q{k} r ON r.b = x.gi // {8 ** (k + 1)}', f'(x.gi // {8**k})')})")
    return "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, leaf, subroot, (SELECT d FROM g{wide}) AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = (SELECT d FROM g{wide}) AS verified FROM u{wide}"


SQL = {"op13_merkle": _sql()}
QUERIES = {"op13_merkle": op13_merkle}
