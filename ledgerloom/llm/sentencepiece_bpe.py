"""SentencePiece encoding and decoding of merge-type (BPE) models by a table of each prefix's last token.

The encoding of a prefix ends with exactly one token. It is found from left to right:
an automaton gives all pieces that end at a position, and a piece is the last token of
that prefix if it is compatible with the last token of the prefix before it, that is,
if the two pieces side by side encode to just these two. Whether two pieces are
compatible depends on nothing else, so the answers are remembered. The ids are then
recovered backwards from the end of the table: time and memory are linear in the text.

No piece reaches from one segment of a text into the next one (`segments`), so segments
are encoded alone, and short ones are remembered in each Python worker.

Decoding is a state machine over ids: byte pieces are held back until they are a
character, and only the first piece loses the space that encoding puts in front.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from ledgerloom.llm.common import fresh, release, small_batches

#: The character that pieces write for a space (fixed by the format).
SPACE = "▁"
#: Segments, and pairs of pieces, that are remembered in each Python worker; only segments up to SHORT characters are.
REMEMBERED, SHORT = 1 << 18, 64
#: Types of pieces in a model file (fixed by the format).
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message; fixed-width values as bytes."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at, out, shift = at + 1, out | (b & 127) << shift, shift + 7
            if b < 128:
                return out

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(key & 7) or number()
        yield key >> 3, data[at : at + size]
        at += size


class PrefixTable:
    """Encoder and decoder for a model file of the sentencepiece library: type BPE, identity normalization, byte fallback. Other models are refused."""

    def __init__(self, path: str):
        import struct

        spec: dict[int, list] = {}
        for n, v in _fields(open(path, "rb").read()):
            spec.setdefault(n, []).append(v)
        trainer, rules = dict(_fields(spec[2][0])), dict(_fields(spec[3][0]))
        if trainer.get(3) != 2 or rules.get(2) or not rules.get(3, 1) or rules.get(4, 1) or not rules.get(5, 1):
            raise ValueError("only models of type BPE with identity normalization, a space in front and all spaces kept")
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        self.score: dict[str, float] = {}
        for i, raw in enumerate(spec[1]):
            got = dict(_fields(raw))
            piece, kind = got[1].decode("utf-8"), got.get(3, NORMAL)
            if kind not in (NORMAL, UNKNOWN, CONTROL, BYTE):
                raise ValueError(f"piece {i} has type {kind}, which is not supported")
            self.pieces.append(piece)
            self.kinds.append(kind)
            if kind == NORMAL:
                self.score[piece] = struct.unpack("<f", got.get(2, bytes(4)))[0]
        self.byte_id = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == BYTE}
        if len(self.byte_id) != 256:
            raise ValueError("a model needs byte pieces for all bytes")
        self.byte_of = {i: bytes([b]) for b, i in self.byte_id.items()}
        self.size = len(self.pieces)
        self.single = {p for p in self.score if len(p) == 1}
        self.automaton = ahocorasick.Automaton()
        for i, (p, k) in enumerate(zip(self.pieces, self.kinds)):
            if k == NORMAL:
                self.automaton.add_word(p, i)
        self.automaton.make_automaton()
        self.length = [len(p) for p in self.pieces]
        self.segments = self._segments()
        self.fits: dict[int, bool] = {}
        self.known: dict[str, tuple[str, int, str]] = {}

    def _segments(self):
        """Function that lists the segments of a text: runs of characters that pieces join, directly or by others, with the spaces before them; any other character alone."""
        words = [p.lstrip(SPACE) for p in self.score]
        if any(SPACE in w for w in words):  # a space inside a piece: nothing but characters that no longer piece has would part words
            words = [p for p in self.score if len(p) > 1]
        root: dict[str, str] = {}

        def find(c: str) -> str:
            while root.setdefault(c, c) != c:
                root[c] = c = root[root[c]]
            return c

        for w in words:
            for x in w[1:]:
                root[find(x)] = find(w[0])
            if w:
                find(w[0])
        classes: dict[str, list[str]] = {}
        for c in root:
            classes.setdefault(find(c), []).append(c)
        more = {c for p in self.score if len(p) > 1 for c in p}  # others are always alone, without the spaces before them
        runs = ["".join(map(re.escape, sorted(x))) for x in sorted(classes.values(), key=len, reverse=True) if more & set(x)]
        return re.compile("|".join([*(f"{SPACE}*[{x}]+" for x in runs), f"{SPACE}+", f"[^{SPACE}]"]), re.S).findall

    # encoding

    def _string(self, token: int) -> str:
        """Tokens beyond the vocabulary stand for single characters that are no piece."""
        return self.pieces[token] if token < self.size else chr(token - self.size)

    def _lengths(self, s: str) -> list[int]:
        """Lengths of the tokens of a short string by its merges: the best score first, of equal ones the leftmost."""
        parts, get, none = list(s), self.score.get, float("-inf")
        while len(parts) > 1:
            scores = [get(a + b, none) for a, b in zip(parts, parts[1:])]
            best = max(scores)
            if best == none:
                break
            i = scores.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [len(p) for p in parts]

    def compatible(self, before: int, token: int) -> bool:
        """Whether two tokens side by side stay these two."""
        a, b = self._string(before), self._string(token)
        return self._lengths(a + b) == [len(a), len(b)]

    def _fits(self, before: int, token: int) -> bool:
        """Whether a token can follow another one, -1 at the start of a segment; remembered in `fits` by the caller."""
        return self.compatible(before, token) if before >= 0 else len(self._lengths(self.pieces[token])) == 1

    def segment_tokens(self, s: str) -> list[int]:
        """Tokens of one segment: the table from left to right, the tokens backwards."""
        n, fits, length, size = len(s), self.fits, self.length, self.size
        last = [-1] * (n + 1) if n < 4096 else array("i", [-1]) * (n + 1)
        for at, c in enumerate(s, 1):
            if c not in self.single:
                last[at] = size + ord(c)  # unless a longer piece that ends here fits
        found = 0
        for at, token in self.automaton.iter(s):
            at += 1
            if at == found:
                continue
            before = last[at - length[token]]
            key = (before + 1) << 21 | token
            ok = fits.get(key)
            if ok is None:
                if len(fits) >= REMEMBERED:
                    fits.clear()
                fits[key] = ok = self._fits(before, token)
            if ok:
                last[at], found = token, at
        out, at = [], n
        while at:
            out.append(t := last[at])
            at -= length[t] if t < size else 1
        out.reverse()
        return out

    def _ids(self, tokens: Iterable[int]) -> Iterator[int]:
        for t in tokens:
            if t < self.size:
                yield t
            else:
                for b in chr(t - self.size).encode("utf-8"):
                    yield self.byte_id[b]

    def prepared(self, text: str | None) -> list[str]:
        """Segments of a text with a space in front; an empty text has none."""
        return self.segments(SPACE + text.replace(" ", SPACE)) if text else []

    def encode(self, text: str | None) -> Iterator[int]:
        for s in self.prepared(text):
            yield from self._ids(self.segment_tokens(s))

    # decoding

    def text(self, ids: Iterable[int], begins: bool = True) -> Iterator[str]:
        """The text of ids, piece by piece. Ids outside the vocabulary raise IndexError."""
        held = b""
        for i in ids:
            if not 0 <= i < self.size:
                raise IndexError(f"no piece {i}")
            if self.kinds[i] == BYTE:
                held += self.byte_of[i]
                out, held = _characters(held, False)
            else:
                out, held = _characters(held, True)[0], b""
                begins = begins and not out
                if self.kinds[i] == NORMAL:
                    p = self.pieces[i]
                    out += (p[1:] if begins and p[0] == SPACE else p).replace(SPACE, " ")
                    begins = False
                elif self.kinds[i] == UNKNOWN:
                    out, begins = out + " ⁇ ", False
            begins = begins and not out
            yield out
        yield _characters(held, True)[0]

    # both, with memory of segments

    def round_trip(self, s: str) -> tuple[str, int, str]:
        """(ids joined by commas, number of ids, text) of a segment."""
        tokens = self.segment_tokens(s)
        if max(tokens) < self.size:
            got = (",".join(map(str, tokens)), len(tokens), "".join([self.pieces[t] for t in tokens]).replace(SPACE, " "))
        else:
            ids = list(self._ids(tokens))
            got = (",".join(map(str, ids)), len(ids), "".join(self.text(ids, False)))
        if len(s) <= SHORT:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[s] = got
        return got


def _characters(held: bytes, end: bool) -> tuple[str, bytes]:
    """Characters of byte pieces, and the bytes of one that isn't complete yet. Each byte that belongs to none becomes U+FFFD."""
    out = ""
    while held:
        b = held[0]
        n = 1 if b < 0x80 else 2 if 0xC2 <= b < 0xE0 else 3 if 0xE0 <= b < 0xF0 else 4 if 0xF0 <= b < 0xF5 else 0
        if n > len(held) and not end and all(0x80 <= x < 0xC0 for x in held[1:]):
            break
        try:
            out, held = out + held[: max(n, 1)].decode("utf-8"), held[max(n, 1) :]
        except UnicodeDecodeError:
            out, held = out + "�", held[1:]
    return out, held


@lru_cache(maxsize=2)
def prefix_table(path: str) -> PrefixTable:
    """One for each file and Python worker."""
    return PrefixTable(path)


def _digests(t: PrefixTable, text: str | None) -> tuple[int, str, str]:
    parts = t.prepared(text)
    ids, plain = hashlib.sha256(), hashlib.sha256()
    if not parts:
        return 0, ids.hexdigest(), plain.hexdigest()
    known, slow = t.known.get, t.round_trip
    n, lead, skip = 0, "", 1  # the space in front is no part of the text
    for at in range(0, len(parts), 8192):
        a, b, c = zip(*[known(s) or slow(s) for s in parts[at : at + 8192]])
        ids.update((lead + ",".join(a)).encode())
        plain.update("".join(c)[skip:].encode())
        n, lead, skip = n + sum(b), ",", 0
    return n, ids.hexdigest(), plain.hexdigest()


def piece_digests(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): every text encoded with the model at `path` and decoded again.

    ids_sha256 is over the decimal ids joined by commas. One row for each row, repeated and tied ones too; null and
    empty texts give no tokens and the digest of nothing. Very long texts take time and memory in proportion to their
    length. An empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    small_batches(df.sparkSession)
    src = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    schema = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches):
        t = prefix_table(path)
        for b in batches:
            rows = [_digests(t, x.as_py()) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *(pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 3, list(schema)[1:]))], schema=schema)
        t.known.clear()  # a worker lives on after its task
        release()

    return src.mapInArrow(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)


def piece_encode(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """`df` with the ids of each text as an array; null and empty texts give an empty one. A column of that name stays, and the new one gets underscores in front."""

    @F.pandas_udf(ArrayType(IntegerType()))
    def encode(texts):
        t = prefix_table(path)
        return texts.map(lambda x: list(t.encode(x)))

    return df.withColumn(fresh(df, ids_col)[0], encode(F.coalesce(F.col(text_col), F.lit(""))))


def piece_decode(df: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """`df` with the text of each array of ids; null gives an empty one. A column of that name stays, and the new one gets underscores in front."""

    @F.pandas_udf("string")
    def decode(ids):
        t = prefix_table(path)
        return ids.map(lambda x: "".join(t.text(x.tolist())))

    return df.withColumn(fresh(df, text_col)[0], decode(F.coalesce(F.col(ids_col), F.array().cast("array<int>"))))


def model(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op11_sentencepiece(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return piece_digests(docs, model())


#: SQL can't express the model; the tests compare with the library.
SQL: dict[str, str] = {}
QUERIES = {"op11_sentencepiece": op11_sentencepiece}
