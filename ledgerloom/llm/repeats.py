"""Removal of byte strings that an earlier document has too, by interval expansion on Burrows-Wheeler transforms.

A corpus has no room for one suffix array, so windows of 50 bytes are dealt to
buckets by their anchor: of the 24-byte strings inside, the one with the least hash, the leftmost of equal ones. Equal windows
have equal anchors at the same place, so each bucket finds its repeats alone. Neighbouring windows
mostly share their anchor; such a run is shipped as one snippet of text. Before any text is
shipped, hashes of anchors tell which occur in two documents, and only snippets of those go on. Each task packs
its hashes by bucket, so the rows grow with the tasks and buckets and never beyond the anchors.

In a bucket, the snippets' suffixes that start at the anchor are sorted, with their common prefixes. From there the strings are
extended backward, breadth first: the transform's column is the byte before each suffix, a stable sort by it is the
LF mapping, and a class of equal strings falls into the intervals of its bytes. After l steps the suffixes that
share 50 bytes are one interval, of which the first l lie before the anchor: these are the windows at that place.
Suffixes that share their string with no other are dropped; expansion stops when 50 bytes are reached on the left.
The least document of each interval decides.

An anchor in very many documents (HOT) would make its bucket grow with the corpus. Its windows are dealt by their own
50 bytes instead: the least document of each is a minimum with partial sums, and the answer goes back to the blocks by a join.

Results return to the documents' blocks as byte ranges by the row's place in its block.
Blocks and buckets get about BLOCK bytes each, so their number grows with the corpus.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import small_batches, text_bytes, written

U = np.uint64
LENGTH = 50
KMER = 24
BLOCK = 8_000_000
#: Bytes that are worked on together.
PIECE = 1_000_000
#: Bytes of text after which a task writes out the anchors that it has seen.
FLUSH = 32_000_000
#: Documents from which an anchor's windows are dealt by themselves.
HOT = 50_000
#: Copies of a repeated text's first id, so that the rows of a hot text meet it in several tasks.
SALTS = 16
#: Bits of an anchor's hash inside its bucket.
SHORT = 27
NEVER = np.iinfo(np.int64).max


def _words(b: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as a number."""
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(b, 8)).view(np.uint64).ravel()


def _pieces(raw: list[bytes]):
    """Lists of (document, offset, bytes) of about PIECE bytes; parts of a long document overlap so that each window is in one part."""
    now, size = [], 0
    for d, r in enumerate(raw):
        if len(r) > 2 * PIECE:
            for o in range(0, len(r) - LENGTH + 1, PIECE):
                yield [(d, o, r[o : o + PIECE + LENGTH - 1])]
        elif len(r) >= LENGTH:
            now.append((d, 0, r))
            size += len(r)
            if size >= PIECE:
                yield now
                now, size = [], 0
    if now:
        yield now


def snippets(piece) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with the same anchor: the joined text, and for each run its start there, its windows, its anchor's hash and place in the run, its document and its offset there."""
    text = b"\xff".join([r for _, _, r in piece]) + b"\xff" * KMER
    b = np.frombuffer(text, np.uint8)
    size = np.array([len(r) for _, _, r in piece])
    begin = np.cumsum(size + 1) - size - 1
    with np.errstate(over="ignore"):
        w = _words(b)
        n = len(w) - (KMER - 8)
        h = w[:n] * U(0x9E3779B97F4A7C15)
        for k in range(8, KMER, 8):
            h ^= h >> U(29)
            h *= U(0xBF58476D1CE4E5B9)
            x = w[k : n + k]
            h ^= (x ^ (x >> U(31))) * U(0xC2B2AE3D27D4EB4F)
        h ^= h >> U(29)
        h *= U(0xBF58476D1CE4E5B9)
        h ^= h >> U(32)
    # the hash's upper bits, and the place below them: the leftmost of equal strings is the least
    bits = U(max(1, int(n).bit_length()))
    least = (h >> bits << bits) | np.arange(n, dtype=np.uint64)
    width, span = 1, LENGTH - KMER + 1
    while width * 2 <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    windows = np.maximum(size - LENGTH + 1, 0)
    part = np.repeat(np.arange(len(piece)), windows)
    offset = np.arange(len(part)) - np.repeat(np.cumsum(windows) - windows, windows)
    at = begin[part] + offset
    place = (least[at] & ((U(1) << bits) - U(1))).astype(np.int64)
    new = np.flatnonzero(np.r_[True, place[1:] != place[:-1]]) if len(at) else np.zeros(0, np.int64)  # a string lies in one document
    count = np.diff(np.r_[new, len(at)])
    doc, base = np.array([d for d, _, _ in piece]), np.array([o for _, o, _ in piece])
    return text, at[new], count, h[place[new]], place[new] - at[new], doc[part[new]], base[part[new]] + offset[new]


def window_minima(snips: list[bytes], at: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least owner of each window of each snippet, among all snippets that have the window: one array for all, and where each snippet begins in it.

    at: places of the anchors. Only bytes are compared, no hashes.
    """
    n, side = len(snips), LENGTH - KMER
    size = np.array([len(s) for s in snips])
    t = np.frombuffer(b"\0" * side + b"".join(snips) + b"\0" * (LENGTH + 6), np.uint8)
    anchor = side + np.cumsum(size) - size + at
    windows = size - LENGTH + 1
    base = np.cumsum(windows) - windows
    out = np.repeat(owners, windows)
    # suffixes from the anchors on, sorted: seven numbers of eight bytes, zero beyond the snippet's end
    right = t[anchor[:, None] + np.arange(LENGTH + 6)]
    right[np.arange(LENGTH + 6) >= np.minimum(size - at, LENGTH)[:, None]] = 0
    column = right.view(">u8").astype(np.uint64)
    order = np.lexsort(column.T[::-1])
    differ = right[order[1:]] != right[order[:-1]]
    common = np.r_[0, np.where(differ.any(1), differ.argmax(1), LENGTH)]  # of each suffix and the one before
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    same_anchor = np.cumsum(common < KMER)[rank]
    before = t[anchor[:, None] - 1 - np.arange(side)]
    left = np.zeros(n, np.int64)  # class of the bytes before the anchor, in the present order
    for step in range(side + 1):
        # strings of `step` bytes before the anchor and LENGTH - step from it on
        tail = np.cumsum(common < LENGTH - step)[rank[order]]
        begun = np.flatnonzero(np.r_[True, (left[1:] != left[:-1]) | (tail[1:] != tail[:-1])])
        here = at[order] - step  # the window in the snippet
        inside = (here >= 0) & (here < windows[order])
        least = np.minimum.reduceat(np.where(inside, owners[order], NEVER), begun)
        least = np.repeat(least, np.diff(np.r_[begun, len(order)]))
        out[(base[order] + here)[inside]] = least[inside]
        if step == side:
            break
        kin = same_anchor[order]
        border = np.r_[True, (left[1:] != left[:-1]) | (kin[1:] != kin[:-1]), True]
        live = ~(border[1:] & border[:-1]) & (at[order] > step)
        order, left = order[live], left[live]
        if not len(order):
            break
        byte = before[order, step]
        lf = np.argsort(byte, kind="stable")
        order, left, byte = order[lf], left[lf], byte[lf]
        left = np.cumsum(np.r_[False, (byte[1:] != byte[:-1]) | (left[1:] != left[:-1])])
    return out, base


def _raw(column) -> list[bytes]:
    return [(x.as_py() or "").encode("utf-8", "surrogatepass") for x in column]


def _binary(data: np.ndarray, cut: np.ndarray) -> pa.Array:
    """Binary values: the items of `data` from each cut to the next."""
    edge = (np.r_[cut, len(data)] * data.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(cut), [None, pa.py_buffer(edge.tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())])


def _cuts(*columns: np.ndarray) -> np.ndarray:
    """Where a new value begins in sorted columns."""
    n = len(columns[0])
    new = np.zeros(max(0, n - 1), bool)
    for c in columns:
        new |= c[1:] != c[:-1]
    return np.flatnonzero(np.r_[True, new]) if n else np.zeros(0, np.int64)


def _runs(ids: np.ndarray, first: np.ndarray, width: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(occurrence, first, last window) of the runs of windows whose least owner is below the occurrence's id. least[first[i] : first[i] + width[i]] are those of occurrence i."""
    who = np.repeat(np.arange(len(ids)), width)
    k = np.arange(len(who)) - np.repeat(np.cumsum(width) - width, width)
    hit = np.r_[False, least[np.repeat(first, width) + k] < ids[who], False]
    same = np.r_[False, who[1:] == who[:-1], False]  # as the one before
    starts = np.flatnonzero(hit[1:-1] & ~(hit[:-2] & same[:-1]))
    ends = np.flatnonzero(hit[1:-1] & ~(hit[2:] & same[1:]))
    return who[starts], k[starts], k[ends]


def _key(anchor: np.ndarray, blocks: int) -> np.ndarray:
    """Bucket of an anchor, and SHORT bits of its hash."""
    return (anchor % U(blocks)) << U(SHORT) | (anchor >> U(32)) & U((1 << SHORT) - 1)


class _Block:
    """The rows of a block, in the order of id and bytes, so that each stage gives a row the same place."""

    def __init__(self, texts: pa.Table):
        ids, raw = texts.column("id").to_pylist(), _raw(texts.column("text"))
        order = sorted(range(len(ids)), key=lambda i: (ids[i], raw[i]))
        self.ids, self.raw = np.array([ids[i] for i in order], np.int64), [raw[i] for i in order]

    def copies(self, copied: set[bytes]) -> list[bool]:
        """Whether each row is a copy of a text with a smaller id."""
        return [bool(copied) and f"{i}:{hashlib.sha256(r).hexdigest()}".encode() in copied for i, r in zip(self.ids, self.raw)]


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, spans[, kept_text]) for each row of `docs`.

    Bytes covered by a string of 50 bytes that also starts in a document with a
    smaller id are removed; spans are the maximal removed runs (start, end). Rows of the same id don't
    remove each other's bytes. Null texts are empty; texts of fewer than 50 bytes stay; rows
    with a null id stay and remove nothing. kept_text leaves out characters that were cut. Very long texts are
    worked on in parts. An empty table gives an empty result, and other columns are ignored.
    """
    small_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    blocks = max(1, math.ceil(text_bytes(src) / BLOCK))
    src = src.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int"))
    # a null id's row has no partner: it is finished apart
    known = src.where("id is not null")

    def anchors(batches):
        """For each bucket: runs of blocks, and for each block the hashes of its anchors with the binary logarithm of their number."""
        schema = pa.schema([("bucket", pa.int32()), ("runs", pa.binary()), ("hashes", pa.binary())])
        seen, size = [], 0

        def packed():
            # merged by bucket, block and hash; `several`: of more than one document
            block, key, count, several = (np.concatenate([x[i] for x in seen]) for i in range(4))
            bucket = (key >> U(SHORT)).astype(np.int64)
            order = np.lexsort((key, block, bucket))
            block, key, bucket, count, several = block[order], key[order], bucket[order], count[order], several[order]
            at = _cuts(block, key)
            total = np.add.reduceat(count, at)
            several = (np.add.reduceat(several, at) > 0) | (np.diff(np.r_[at, len(key)]) > 1)
            level = np.where(several, np.maximum(1, np.log2(total).astype(np.int64)), 0)
            block, bucket, short = block[at], bucket[at], key[at] & U((1 << SHORT) - 1)
            run = _cuts(bucket, block)
            row = _cuts(bucket)
            runs = np.stack([block[run], np.diff(np.r_[run, len(block)])], 1).astype(np.int32)
            told = (short << U(5) | np.minimum(level, 31).astype(np.uint64)).astype(np.uint32)
            of = np.searchsorted(run, row)
            return pa.RecordBatch.from_arrays([pa.array(bucket[row], pa.int32()), _binary(runs.ravel(), 2 * of), _binary(told, row)], schema=schema)

        for b in batches:
            raw, block = _raw(b.column(1)), b.column(2).to_numpy()
            for piece in _pieces(raw):
                _, _, _, anchor, _, doc, _ = snippets(piece)
                key, own = _key(anchor, blocks), block[doc].astype(np.int64)
                order = np.lexsort((key, own)) if own.min() != own.max() else np.argsort(key)
                key, own, doc = key[order], own[order], doc[order]
                at = _cuts(key, own)
                seen.append((own[at], key[at], np.diff(np.r_[at, len(key)]), (np.minimum.reduceat(doc, at) != np.maximum.reduceat(doc, at)).astype(np.int64)))
                size += sum(len(r) for _, _, r in piece)
                if size >= FLUSH:
                    yield packed()
                    seen.clear()
                    size = 0
        if seen:
            yield packed()

    def repeated(t: pa.Table) -> pa.Table:
        """One bucket: for each block, the hashes that another document has as well; the lowest bit is set for those of very many."""
        runs = np.frombuffer(b"".join(t.column("runs").to_pylist()), np.int32).reshape(-1, 2)
        told = np.frombuffer(b"".join(t.column("hashes").to_pylist()), np.uint32)
        block, short, level = np.repeat(runs[:, 0], runs[:, 1]), told >> 5, told & 31
        order = np.argsort(short, kind="stable")
        at = _cuts(short[order])
        number = np.diff(np.r_[at, len(order)])
        documents = np.add.reduceat(2.0 ** level[order], at)
        shared = (number > 1) | (np.maximum.reduceat(level[order], at) > 0)
        keep = np.repeat(shared, number)
        told = short[order].astype(np.uint64) << U(1) | np.repeat(documents >= HOT, number).astype(np.uint64)
        key = np.unique((block[order].astype(np.uint64) << U(32) | told)[keep])
        owner, told = (key >> U(32)).astype(np.int32), key.astype(np.uint32)
        cut = _cuts(owner)
        return pa.table({"block": pa.array(owner[cut], pa.int32()), "bucket": pa.array(np.full(len(cut), t.column("bucket")[0].as_py()), pa.int32()), "hashes": _binary(told, cut), "hot": pa.array([bool((x & 1).any()) for x in np.split(told, cut[1:])][: len(cut)], pa.bool_())})

    shared = known.select("id", "text", "block").mapInArrow(anchors, "bucket int, runs binary, hashes binary")
    shared = written(shared.groupBy("bucket").applyInArrow(repeated, "block int, bucket int, hashes binary, hot boolean"))

    # copies of whole texts: all their windows are in the first one, so they ship nothing
    rows_ = known.where(F.octet_length("text") >= LENGTH).select("id", "block", F.sha2("text", 256).alias("sha"), F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt"))
    first = rows_.groupBy("sha").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("last > first")
    first = first.select("sha", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    copies = rows_.join(first, ["sha", "salt"]).where("id > first").select("block", F.encode(F.concat_ws(":", "id", "sha"), "utf-8").alias("hashes"))
    shared = shared.unionByName(written(copies).select("block", F.lit(-1).alias("bucket"), "hashes", F.lit(False).alias("hot")))

    def occurrences(texts: pa.Table, told: pa.Table, hot: bool):
        """(text of a piece, start, windows, anchor, its place, document, offset) of the snippets of a block whose anchor is shared, and hot or not; last the block's rows."""
        block = _Block(texts)
        entries = list(zip(told.column("hashes"), told.column("bucket").to_pylist()))
        copied = {h.as_py() for h, k in entries if k < 0}
        wanted = [np.frombuffer(h.as_buffer(), np.uint32).astype(np.uint64) + (U(k) << U(SHORT + 1)) for h, k in entries if k >= 0]
        wanted = np.concatenate(wanted) if wanted else np.zeros(0, np.uint64)
        wanted = np.sort(wanted[(wanted & U(1)) == U(hot)] >> U(1))
        if len(wanted):
            for piece in _pieces([b"" if c else r for c, r in zip(block.copies(copied), block.raw)]):
                text, start, count, anchor, place, doc, offset = snippets(piece)
                key = _key(anchor, blocks)
                on = wanted[np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)] == key
                yield block, text, (start[on], count[on], anchor[on], place[on], doc[on], offset[on])

    sent = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("place", pa.int32()), ("snippet", pa.binary()), ("where", pa.binary())])
    occurrence = np.dtype([("id", "<i8"), ("row", "<i4"), ("offset", "<i4")])

    def ship(texts: pa.Table, told: pa.Table) -> pa.Table:
        """The distinct snippets of a block's cold anchors, with all their occurrences."""
        if not texts.num_rows:
            return sent.empty_table()
        found: dict[bytes, int] = {}
        which, where, bucket, at = [], [], [], []
        for block, text, (start, count, anchor, place, doc, offset) in occurrences(texts, told, False):
            end = start + count + (LENGTH - 1)
            n = len(found)
            got = np.array([found.setdefault(text[s:e], len(found)) for s, e in zip(start.tolist(), end.tolist())], np.int64)
            new = np.unique(got, return_index=True)
            new = new[1][new[0] >= n]
            bucket.append((anchor[new] % U(blocks)).astype(np.int32))
            at.append(place[new].astype(np.int32))
            which.append(got)
            where.append(np.rec.fromarrays([block.ids[doc], doc.astype(np.int32), offset.astype(np.int32)], dtype=occurrence))
        if not found:
            return sent.empty_table()
        which, where = np.concatenate(which), np.concatenate(where)
        order = np.argsort(which, kind="stable")
        own = texts.column("block")[0].as_py()
        return pa.Table.from_arrays(
            [pa.array(np.concatenate(bucket)), pa.array(np.full(len(found), own, np.int32)), pa.array(np.concatenate(at)), pa.array(list(found), pa.binary()), _binary(where[order], _cuts(which[order]))], schema=sent
        )

    marked = pa.schema([("block", pa.int32()), ("marks", pa.binary())])
    mark = np.dtype([("row", "<i4"), ("start", "<i4"), ("end", "<i4")])

    def marks_of(block, where, first, width, least) -> pa.Table:
        """Byte ranges to remove, by block. block, where, first and width are by occurrence."""
        who, a, z = _runs(where["id"], first, width, least)
        order = np.argsort(block[who], kind="stable")
        who, a, z = who[order], a[order], z[order]
        out = np.rec.fromarrays([where["row"][who], where["offset"][who] + a, where["offset"][who] + z + LENGTH], dtype=mark)
        cut = _cuts(block[who])
        return pa.Table.from_arrays([pa.array(block[who][cut], pa.int32()), _binary(out, cut)], schema=marked)

    def expand(t: pa.Table) -> pa.Table:
        coded = t.column("snippet").combine_chunks().dictionary_encode()
        code, snips = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        where = np.frombuffer(b"".join(t.column("where").to_pylist()), occurrence)
        number = np.array([len(x) // occurrence.itemsize for x in t.column("where").to_pylist()])
        of = np.repeat(code, number)
        owners = np.full(len(snips), NEVER)
        np.minimum.at(owners, of, where["id"])
        at = np.zeros(len(snips), np.int64)
        at[code] = t.column("place").to_numpy()
        least, base = window_minima(snips, at, owners)
        width = np.array([len(s) - LENGTH + 1 for s in snips])
        on = np.minimum.reduceat(least, base)[of] < where["id"]
        return marks_of(np.repeat(t.column("block").to_numpy(), number)[on], where[on], base[of[on]], width[of[on]], least)

    met = known.groupBy("block").cogroup(shared.groupBy("block"))
    shipped = met.applyInArrow(ship, "bucket int, block int, place int, snippet binary, where binary")
    marks = written(shipped.groupBy("bucket").applyInArrow(expand, "block int, marks binary"))

    if shared.where("hot").limit(1).count():
        alone = pa.schema([("block", pa.int32()), ("own", pa.binary()), ("least", pa.int64()), ("most", pa.int64()), ("where", pa.binary())])

        def windows(texts: pa.Table, told: pa.Table) -> pa.Table:
            """The distinct windows of a block's hot anchors, with all their occurrences."""
            found: dict[bytes, list] = {}
            for block, text, (start, count, _, _, doc, offset) in occurrences(texts, told, True) if texts.num_rows else ():
                for s, c, d, o in zip(start.tolist(), count.tolist(), doc.tolist(), offset.tolist()):
                    for k in range(c):
                        found.setdefault(text[s + k : s + k + LENGTH], []).append((int(block.ids[d]), d, o + k))
            where = [np.array(x, occurrence) for x in found.values()]
            least, most = ([int(f(x["id"])) for x in where] for f in (np.min, np.max))
            return pa.Table.from_arrays([pa.array([texts.column("block")[0].as_py()] * len(found), pa.int32()), pa.array(list(found), pa.binary()), pa.array(least, pa.int64()), pa.array(most, pa.int64()), pa.array([x.tobytes() for x in where], pa.binary())], schema=alone)

        def settle(batches):
            for b in batches:
                if b.num_rows:
                    where = np.frombuffer(b"".join(b.column(1).to_pylist()), occurrence)
                    number = np.array([len(x) // occurrence.itemsize for x in b.column(1).to_pylist()])
                    of = np.repeat(np.arange(b.num_rows), number)
                    yield from marks_of(b.column(0).to_numpy()[of], where, of, np.ones(len(of), np.int64), b.column(2).to_numpy()).to_batches()

        hot = written(met.applyInArrow(windows, "block int, own binary, least long, most long, where binary"))
        earliest = hot.groupBy("own").agg(F.min("least").alias("earliest")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        told = hot.withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(SALTS)).cast("int")).join(earliest.hint("merge"), ["own", "salt"]).where("most > earliest").select("block", "where", "earliest")
        marks = marks.unionByName(written(told.mapInArrow(settle, "block int, marks binary")))

    fields = [("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
    made = pa.schema(fields + [("kept_text", pa.string())] * keep_text)
    ddl = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:bigint,end:bigint>>" + ", kept_text string" * keep_text

    def rows_of(ids, raw, ranges) -> pa.Table:
        """ranges(d): starts and ends of what goes of row d, or None."""
        rows = []
        for d, (id_, r) in enumerate(zip(ids, raw)):
            spans, kept = [], r
            if (got := ranges(d)) is not None:
                order = np.argsort(got[0], kind="stable")
                start, end = got[0][order], np.maximum.accumulate(got[1][order])
                new = np.r_[True, start[1:] > end[:-1]]
                spans = list(zip(start[new].tolist(), end[np.r_[new[1:], True]].tolist()))
                kept = b"".join([r[a:z] for a, z in zip([0] + [z for _, z in spans], [a for a, _ in spans] + [len(r)])])
            row = (id_, len(r), len(r) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), [dict(start=a, end=z) for a, z in spans])
            rows.append(row + ((kept.decode("utf-8", "ignore"),) if keep_text else ()))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(made), made)], schema=made)

    def finish(texts: pa.Table, results: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return made.empty_table()
        block = _Block(texts)
        entries = list(zip(results.column("marks").to_pylist(), results.column("copy").to_pylist()))
        gone = np.frombuffer(b"".join(m for m, c in entries if not c), mark)
        gone = gone[np.argsort(gone["row"], kind="stable")]
        cut = np.searchsorted(gone["row"], np.arange(len(block.raw) + 1))
        whole = block.copies({m for m, c in entries if c})

        def ranges(d):
            if whole[d]:
                return np.zeros(1, np.int64), np.array([len(block.raw[d])])
            part = gone[cut[d] : cut[d + 1]]
            return (part["start"], part["end"]) if len(part) else None

        return rows_of(block.ids.tolist(), block.raw, ranges)

    def apart(batches):
        for b in batches:
            yield from rows_of(b.column(0).to_pylist(), _raw(b.column(1)), lambda d: None).to_batches()

    results = marks.withColumn("copy", F.lit(False)).unionByName(shared.where("bucket < 0").select("block", F.col("hashes").alias("marks"), F.lit(True).alias("copy")))
    out = known.groupBy("block").cogroup(results.groupBy("block")).applyInArrow(finish, ddl)
    out = out.unionByName(src.where("id is null").select("id", "text").mapInArrow(apart, ddl))
    return out.withColumnRenamed("id", id_col)


def op8_repeats(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return repeated_spans(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


SQL: dict[str, str] = {}
QUERIES = {"op8_repeats": op8_repeats}
