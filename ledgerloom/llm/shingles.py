"""Word shingles of many texts at once, on bytes with numpy."""

from __future__ import annotations

import numpy as np

U = np.uint64
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
#: Bytes of texts that are worked on together.
CHUNK = 2_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose outputs look random."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def chunks(texts: list[str | None]):
    """Runs of rows (from, to) of about CHUNK bytes of text."""
    begun = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t or "") > CHUNK:
            yield begun, i
            begun, size = i, 0
        size += len(t or "")
    if begun < len(texts):
        yield begun, len(texts)


def shingle_sets(texts: list[str | None], n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, hashes): the distinct n-word shingles of text i are hashes[offsets[i] : offsets[i + 1]], sorted.

    A-Z are lower-cased, words are split at white space of ASCII. A text of fewer words,
    but not none, is one shingle; null and empty texts have none.
    """
    raw = [(t or "").encode("utf-8", "surrogatepass").translate(_LOWER) for t in texts]
    size = np.array([len(r) + 1 for r in raw], np.int64)
    buf = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    white = _WHITE[buf]
    edge = np.flatnonzero(white[1:] != white[:-1]) + 1
    if len(white) and not white[0]:
        edge = np.r_[0, edge]
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.r_[U(1), np.full(len(buf) - 1, U(_BASE))])
        total = np.r_[U(0), np.cumsum(_BYTE[buf] * power)]
        back = np.cumprod(np.r_[U(1), np.full(len(buf) - 1, U(_INVERSE))])
        word = mix((total[end] - total[start]) * back[start] + (end - start).astype(np.uint64))
        del power, total, back
        doc = np.searchsorted(np.cumsum(size), start, "right")
        count = np.bincount(doc, minlength=len(texts))
        first = np.cumsum(count) - count
        left = (first + count)[doc] - np.arange(len(word))  # words from here to the text's end
        head = np.flatnonzero((left >= n) | (np.arange(len(word)) == first[doc]) & (count[doc] < n))
        width = np.minimum(left[head], n)
        h = np.zeros(len(head), np.uint64)
        for k in range(n):
            live = width > k
            h[live] = mix(h[live] * U(3) + word[head[live] + k])
        h = mix(h + width.astype(np.uint64))
    owner = doc[head]
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])]
    h, owner = h[new], owner[new]
    return np.r_[0, np.cumsum(np.bincount(owner, minlength=len(texts)))], h


def sketches(offsets: np.ndarray, hashes: np.ndarray, t: int) -> np.ndarray:
    """Fast similarity sketches, (texts, t): in round i < t each element falls into a random bin, in round t + i all fall into bin i.

    A bin keeps its least (round, value); rounds go on until all bins of a text are
    full, which the last t rounds guarantee. The chance that a coordinate of two sets agrees is their
    Jaccard similarity, with concentration as for independent ones. Rows of empty sets stay at the maximum.
    """
    n = len(offsets) - 1
    full = U(0xFFFFFFFFFFFFFFFF)
    out = np.full((n, t), full)
    size = np.diff(offsets)
    owner = np.repeat(np.arange(n), size)
    open_ = size > 0
    for i in range(2 * t):
        live = open_[owner]
        if not live.any():
            break
        who, h = owner[live], mix(hashes[live] ^ mix(np.full(1, U(i + 1)))[0])
        value = (U(i) << U(48)) | (h & U((1 << 48) - 1))
        bins = ((h >> U(48)) * U(t) >> U(16)).astype(np.int64) if i < t else np.full(len(h), i - t)
        np.minimum.at(out.reshape(-1), who * t + bins, value)
        open_ &= (out == full).any(1)
    return out


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(texts, bands): a hash of each run of `rows` coordinates."""
    h = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64)), (len(sketch), bands)).copy()
    for r in range(rows):
        h = mix(h * U(3) + sketch[:, r : bands * rows : rows])
    return h
