"""Bounded rankings inside tasks: the best k of each query as arrays, and sparse sums of term weights."""

from __future__ import annotations

import numpy as np

#: (document, query) cells that are worked on together.
CELLS = 4_000_000


class Best:
    """The best k of n queries: greatest score first, of equal scores the smaller id. Memory is n * k, whatever is added."""

    def __init__(self, n: int, k: int):
        self.k, self.score, self.id = k, np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max, np.int64)

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        """Hits as triples; non-finite scores are none."""
        if not self.k:
            return
        last = self.score[query, -1]
        near = np.nonzero((score > last) | ((score == last) & (ids < self.id[query, -1]) & np.isfinite(score)))[0]
        if not len(near):
            return
        query, ids, score = query[near], ids[near], score[near]
        touched, at = np.unique(query, return_inverse=True)
        rows = np.r_[np.repeat(np.arange(len(touched)), self.k), at]
        all_score, all_id = np.r_[self.score[touched].ravel(), score], np.r_[self.id[touched].ravel(), ids]
        order = np.lexsort((all_id, -all_score, rows))
        sizes = np.bincount(rows, minlength=len(touched))
        first = np.r_[0, np.cumsum(sizes)[:-1]]
        take = order[(first[:, None] + np.arange(self.k)).ravel()]
        self.score[touched], self.id[touched] = all_score[take].reshape(-1, self.k), all_id[take].reshape(-1, self.k)

    def add_block(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        """Hits as a matrix (len(ids), len(query))."""
        for at in range(0, len(ids), 1024):
            part = score[at : at + 1024]
            row, col = np.nonzero((part >= self.score[query, -1]) & np.isfinite(part))
            self.add(query[col], ids[at + row], part[row, col])

    def hits(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, score) of all that was kept."""
        query, place = np.nonzero(np.isfinite(self.score))
        return query, self.id[query, place], self.score[query, place]


class Asks:
    """Which queries ask for a term, as a sparse matrix by term, and what they may see.

    `allowed` restricts: for each name (codes by value, and the sorted keys query * len(codes) + code); a query that has values of a
    name sees only rows that share one of them. With `scope` (codes by value, and each query's code) a query sees only rows of its own scope.
    """

    def __init__(self, pairs: np.ndarray, terms: int, queries: int, allowed: dict | None = None, scope: tuple | None = None):
        pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
        self.query, self.start = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(terms + 1))
        self.n, self.allowed, self.scope = queries, allowed or {}, scope

    def scores(self, doc: np.ndarray, term: np.ndarray, weight: np.ndarray):
        """(doc, query, sum of weights) of the postings' pairs, in blocks; postings are sorted by doc."""
        each = self.start[term + 1] - self.start[term]
        keep = each > 0
        doc, term, weight, each = doc[keep], term[keep], weight[keep], each[keep]
        if not len(doc):
            return
        ends = np.r_[np.nonzero(np.diff(doc))[0] + 1, len(doc)]  # of documents
        size, begin = np.cumsum(each)[ends - 1], 0
        while begin < len(ends):  # whole documents of about CELLS pairs
            base = size[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(size, base + CELLS, "right")))
            a, z = (ends[begin - 1] if begin else 0), ends[end - 1]
            n = each[a:z]
            where = np.repeat(self.start[term[a:z]] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            low = doc[a]
            key = np.repeat(doc[a:z] - low, n) * self.n + self.query[where]
            w = np.repeat(weight[a:z], n)
            span = int(doc[z - 1] - low + 1) * self.n
            if span <= 4 * len(key) or span <= 100_000:
                total, there = np.bincount(key, w, minlength=span), np.bincount(key, minlength=span)
                got = np.nonzero(there)[0]
                total = total[got]
            else:
                got, at = np.unique(key, return_inverse=True)
                total = np.bincount(at, w)
            yield got // self.n + low, got % self.n, total
            begin = end

    def seen(self, doc: np.ndarray, query: np.ndarray, values: dict[str, list], scopes: list | None) -> np.ndarray:
        """Whether a query may see a document; values by name and scopes are lists by document."""
        ok = np.ones(len(doc), bool)
        if self.scope is not None and scopes is not None:
            codes, own = self.scope
            of = np.array([codes.get(x, -1) if x is not None else -1 for x in scopes], np.int64)
            ok &= (of[doc] >= 0) & (of[doc] == own[query])
        for name, (codes, keys, limited) in self.allowed.items():
            tags = [[codes[t] for t in x or [] if t in codes] for x in values[name]]
            count = np.array([len(x) for x in tags], np.int64)
            flat, start = np.array([t for x in tags for t in x], np.int64), np.r_[0, np.cumsum(count)]
            ask = np.nonzero(ok & limited[query])[0]
            n = count[doc[ask]]
            where = np.repeat(start[doc[ask]] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            key = np.repeat(query[ask], n) * max(1, len(codes)) + flat[where]
            hit = np.zeros(len(ask), bool)
            if len(key) and len(keys):
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                hit[np.repeat(np.arange(len(ask)), n)[keys[at] == key]] = True
            ok[ask] = hit
        return ok


def restriction(values: list) -> tuple[dict, np.ndarray, np.ndarray]:
    """(codes, sorted keys query * len(codes) + code, whether a query has values) of the values of each query."""
    codes = {t: i for i, t in enumerate(sorted({t for x in values for t in x or []}))}
    keys = np.array(sorted({q * max(1, len(codes)) + codes[t] for q, x in enumerate(values) for t in x or []}), np.int64)
    return codes, keys, np.array([bool(x) for x in values], bool)


def scope_codes(values: list) -> tuple[dict, np.ndarray]:
    codes = {t: i for i, t in enumerate(sorted({x for x in values if x is not None}))}
    return codes, np.array([-2 if x is None else codes[x] for x in values], np.int64)
