"""BPE encoding and decoding by a bounded-lookahead streaming transducer.

A merge list bounds how far to the right of a position a text can influence the
tokens that end at that position. `sufficient_lookahead` computes such a bound
from the list. The transducer keeps a window of the current word, encodes the
window, emits the tokens that end at least the lookahead before the window's
end, and goes on from the last boundary emitted: memory is constant however long
the word is. Whole texts are read in slices that end at white space.

Merges never cross a boundary of the final tokens, so the two sides of a boundary
are encoded independently; that is why going on from an emitted boundary gives
the tokens of the whole word.

Decoding is incremental as well: `pieces` writes the token strings with spaces
between, as the tokenizers library does for a file without decoder, and
`ByteText` turns tokens into text byte by byte, with an incomplete character as state.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerloom.llm.common import fresh, release, small_batches

#: Characters of a text that are read at once.
SLICE = 1 << 16
#: Words longer than this are encoded in windows.
DIRECT = 256
#: Words whose tokens are remembered in each Python worker.
REMEMBERED = 1 << 18

# The white space characters of Unicode.
WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"


def byte_chars() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    out = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(plain))
    return [out[b] for b in range(256)]


def _splitter(top: int):
    """Function that lists the words of a text all whose characters are below `top`. Classes are spelled out up to there only, for speed."""
    out = []
    for major in "LN":
        ranges, begun = [], None
        for c in range(top + 1):
            is_in = c < top and unicodedata.category(chr(c))[0] == major
            if is_in and begun is None:
                begun = c
            elif not is_in and begun is not None:
                ranges.append(f"\\U{begun:08x}-\\U{c - 1:08x}")
                begun = None
        out.append("".join(ranges))
    letters, numbers = out
    white = "".join(c for c in WHITE if ord(c) < top)
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{white}{letters}{numbers}]+").findall


def sufficient_lookahead(merges: list[tuple[str, str]]) -> int:
    """How many symbols to the right of a position can matter for the tokens that end there.

    A change of what follows can reach to the left only by a chain of merges of
    falling priority: each next merge takes part with its right half in what the merge
    before took or made, and so reaches further by its left half. `reach[r]` is the
    longest way to the left of the start of merge r on such chains; it depends only on
    merges of lower priority. Merges of the same rank go from left to right, so they
    carry no influence to the left.
    """
    by_right: dict[str, int] = {}  # right half -> longest way that a merge with it goes to the left of that half
    by_left: dict[str, int] = {}  # left half -> the same, from the start of that half
    longest = most = 0
    for u, v in reversed(merges):
        made = u + v
        reach = max(0, by_right.get(u, 0), by_right.get(made, 0), by_left.get(made, 0), by_left.get(v, 0) - len(u), by_right.get(v, 0) - len(u))
        by_right[v] = max(by_right.get(v, 0), len(u) + reach)
        by_left[u] = max(by_left.get(u, 0), reach)
        longest, most = max(longest, len(made)), max(most, len(made) + reach)
    return most + longest


class Transducer:
    """Encoder and decoder for a vocabulary file of the tokenizers library: BPE with word ends on byte-level symbols, after NFC, white space replacement and lower-casing."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_ids = set(self.special.values())
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {(self.vocab[a], self.vocab[b]): (r, self.vocab[a + b]) for r, (a, b) in enumerate(pairs)}
        self.lookahead = sufficient_lookahead([(a.removesuffix(self.end), b.removesuffix(self.end)) for a, b in pairs])
        self.piece = {i: s for s, i in [*self.vocab.items(), *self.special.items()]}
        self.chars = byte_chars()
        self.splitters = [(re.compile(rf"[^\0-\U{top - 1:08x}]").search, _splitter(top)) for top in (0x80, 0x100, 0x10000)]
        self.split_any = _splitter(sys.maxunicode + 1)
        self.white = re.compile(f"[{WHITE}]")
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.first, self.closing = [self.vocab[c] for c in self.chars], [self.vocab[c + self.end] for c in self.chars]
        #: bytes of each token, and whether it ends a word
        self.bytes_of = {i: (bytes(byte[c] for c in s.removesuffix(self.end)), s.endswith(self.end)) for byte in [{c: b for b, c in enumerate(self.chars)}] for s, i in self.vocab.items()}
        self.known: dict[str, tuple[str, int, str, str]] = {}

    # encoding

    def _merge(self, ids: list[int]) -> list[int]:
        """All merges on a bounded list of symbols, by a heap of the pairs over a linked list."""
        n = len(ids)
        if n < 2:
            return ids
        ranks, left, right = self.ranks, list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(got[0], i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (got := ranks.get((a, b)))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = ranks[a, b][1], -1
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                if got := ranks.get((ids[i], ids[k])):
                    heapq.heappush(heap, (got[0], i, ids[i], ids[k]))
            if (h := left[i]) >= 0 and (got := ranks.get((ids[h], ids[i]))):
                heapq.heappush(heap, (got[0], h, ids[h], ids[i]))
        return [x for x in ids if x >= 0]

    def _merge_short(self, ids: list[int]) -> list[int]:
        """The same for short lists, where scanning the ranks of all pairs is faster."""
        get, none = self.ranks.get, (1 << 30, -1)
        pairs = [get(p, none) for p in zip(ids, ids[1:])]
        while pairs:
            best = min(pairs)
            if best is none:
                break
            i = pairs.index(best)
            ids[i : i + 2] = [best[1]]
            del pairs[i]
            if i:
                pairs[i - 1] = get((ids[i - 1], ids[i]), none)
            if i < len(pairs):
                pairs[i] = get((ids[i], ids[i + 1]), none)
        return ids

    def _symbols(self, word: bytes, last: bool) -> list[int]:
        first = self.first
        out = [first[b] for b in word]
        if last and out:
            out[-1] = self.closing[word[-1]]
        return out

    def word_ids(self, word: bytes) -> Iterator[int]:
        """The tokens of one word, each emitted once no later symbol can change it."""
        if len(word) <= DIRECT:
            yield from (self._merge_short if len(word) <= 24 else self._merge)(self._symbols(word, True))
            return
        at, window = 0, 2 * self.lookahead + DIRECT
        while at < len(word):
            last = at + window >= len(word)
            stable, done = at + window - self.lookahead, at
            for t in self._merge(self._symbols(word[at : at + window], last)):
                end = done + len(self.piece[t].removesuffix(self.end))
                if not last and end > stable:
                    break
                yield t
                done = end
            at = done

    def _words(self, s: str) -> list[str]:
        for beyond, split in self.splitters:
            if not beyond(s):
                return split(s)
        return self.split_any(s)

    def _slices(self, text: str) -> Iterator[list[str | int]]:
        """Words of a text slice by slice, with special tokens as their ids."""
        parts = self.specials.split(text) if self.specials else [text]
        for part in parts:
            if part in self.special:
                yield [self.special[part]]
                continue
            at = 0
            while at < len(part):
                to = at + SLICE
                if to < len(part) and part[to - 1] not in WHITE:
                    more = self.white.search(part, to)
                    to = more.end() if more else len(part)
                s = part[at:to]
                if not s.isascii():
                    s = unicodedata.normalize("NFC", s).replace("Σ", "σ")  # lower() would look at a sigma's neighbours
                yield self._words(s.lower())
                at = to

    def encode(self, text: str | None) -> Iterator[int]:
        for words in self._slices(text or ""):
            for w in words:
                if isinstance(w, int):
                    yield w
                else:
                    yield from self.word_ids(w.encode("utf-8"))

    # decoding

    def pieces(self, ids: Iterable[int]) -> str:
        """As the tokenizers library decodes with a file that names no decoder."""
        return " ".join(self.piece[i] for i in ids)

    def text(self, ids: Iterable[int]) -> Iterator[str]:
        """The text of tokens; words end with a space."""
        state = ByteText()
        for i in ids:
            data, ends = self.bytes_of.get(i, (b"", False))
            if i in self.special_ids:
                yield state.flush() + self.piece[i]
            else:
                yield state.feed(data) + (state.flush() + " " if ends else "")
        yield state.flush()

    # both, with memory of words

    def round_trip(self, word: str | int) -> tuple[str, str, str, int]:
        """(ids joined by spaces, pieces, text, number of ids) of a word or special token."""
        if (got := self.known.get(word)) is None:
            ids = [word] if isinstance(word, int) else list(self.word_ids(word.encode("utf-8")))
            got = (" ".join(map(str, ids)), self.pieces(ids), "".join(self.text(ids)), len(ids))
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            if isinstance(word, int) or len(word) <= 64:
                self.known[word] = got
        return got


class ByteText:
    """Bytes to text, one step at a time. The state is the bytes of a character that isn't complete yet; wrong bytes become U+FFFD."""

    def __init__(self):
        self._rest = b""

    def feed(self, data: bytes) -> str:
        data = self._rest + data
        out, used = codecs.utf_8_decode(data, "replace", False)
        self._rest = data[used:]
        return out

    def flush(self) -> str:
        out, self._rest = self._rest.decode("utf-8", "replace"), b""
        return out


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    """One for each file and Python worker."""
    return Transducer(path)


def _digests(t: Transducer, text: str | None) -> tuple[int, str, str, str]:
    n, lead = 0, ""
    ids, pieces, plain = hashlib.sha256(), hashlib.sha256(), hashlib.sha256()
    known, slow = t.known.get, t.round_trip
    for words in t._slices(text or ""):
        if words:
            a, b, c, d = zip(*[known(w) or slow(w) for w in words])
            ids.update((lead + " ".join(a)).encode())
            pieces.update((lead + " ".join(b)).encode())
            plain.update("".join(c).encode())
            n, lead = n + sum(d), " "
    return n, ids.hexdigest(), pieces.hexdigest(), plain.hexdigest()


def bpe_digests(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256, text_sha256): every text encoded and decoded again.

    ids_sha256 is over the decimal ids, decoded_sha256 over the token strings, both
    joined by a space; text_sha256 over the text that the byte machine gives back.
    One row for each row; null and empty texts give no tokens and the digest of
    nothing. Other columns are ignored.
    """
    small_batches(df.sparkSession)
    src = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    schema = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("text_sha256", pa.string())])

    def run(batches):
        t = transducer(path)
        for b in batches:
            rows = [_digests(t, x.as_py()) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *(pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 4, list(schema)[1:]))], schema=schema)
        t.known.clear()  # a worker lives on after its task
        release()

    return src.mapInArrow(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string, text_sha256 string").withColumnRenamed("id", id_col)


def bpe_encode(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """`df` with the token ids of each text as an array; null texts give an empty one. A column of that name stays, and the new one gets underscores in front."""
    from pyspark.sql import functions as F
    from pyspark.sql.types import ArrayType, IntegerType

    @F.pandas_udf(ArrayType(IntegerType()))
    def encode(texts):
        t = transducer(path)
        return texts.map(lambda x: list(t.encode(x)))

    return df.withColumn(fresh(df, ids_col)[0], encode(F.coalesce(F.col(text_col), F.lit(""))))


def bpe_decode(df: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """`df` with the text of each array of ids, as the byte machine gives it back; null gives an empty one. A column of that name stays, and the new one gets underscores in front."""
    from pyspark.sql import functions as F

    @F.pandas_udf("string")
    def decode(ids):
        t = transducer(path)
        return ids.map(lambda x: "".join(t.text([] if x is None else x.tolist())))

    return df.withColumn(fresh(df, text_col)[0], decode(F.coalesce(F.col(ids_col), F.array().cast("array<int>"))))


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return bpe_digests(docs, vocabulary())


SQL: dict[str, str] = {}
QUERIES = {"op1_bpe": op1_bpe}
