import hashlib
import random

import numpy as np

from ledgerloom.llm import repeats


def brute(docs):
    raw = {d: (t or "").encode() for d, t in docs}
    least = {}
    for d, r in raw.items():
        for i in range(len(r) - 49):
            w = r[i : i + 50]
            least[w] = min(least.get(w, d), d)
    out = {}
    for d, r in raw.items():
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - 49):
            if least[r[i : i + 50]] < d:
                gone[i : i + 50] = True
        edge = np.diff(np.r_[0, gone.astype(int), 0])
        out[d] = (len(r), int(gone.sum()), int((edge == 1).sum()), hashlib.sha256(bytes(b for b, g in zip(r, gone) if not g)).hexdigest())
    return out


def corpus():
    rnd = random.Random(2)
    say = lambda n: "".join(rnd.choice("abcdé \n") for _ in range(n))
    shared = [say(n) for n in (49, 50, 51, 120, 400)]
    texts = [None, "", "x" * 49, "x" * 50, "x" * 300, "ab" * 200, "ab" * 30, shared[4], shared[4], shared[4][:-1] + "z", say(9000)]
    for _ in range(60):
        texts.append("".join(rnd.choice([say(rnd.randint(0, 80)), rnd.choice(shared), rnd.choice(shared)[rnd.randint(0, 30) :]]) for _ in range(rnd.randint(1, 6))))
    texts += [texts[10], texts[10][4000:] + say(10)]
    rnd.shuffle(texts)
    return list(enumerate(texts))


def test_against_brute_force(spark, monkeypatch):
    docs = corpus()
    monkeypatch.setattr(repeats, "BLOCK", 3000)
    df = spark.createDataFrame([(d, t, 0) for d, t in docs] + [(None, docs[3][1], 0)], "doc_id long, text string, block int")
    rows = repeats.repeated_spans(df).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows}
    assert got.pop(None)[1] == 0 and len(rows) == len(docs) + 1
    assert got == brute(docs)
    assert repeats.repeated_spans(df.limit(0)).count() == 0
    assert "kept_text" in repeats.repeated_spans(df, keep_text=True).columns


def hot_corpus():
    """One passage between different texts in all documents, and one in every third."""
    rnd = random.Random(9)
    say = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    often, third = say(70), say(200)
    return [(i, say(rnd.randint(0, 60)) + often + say(rnd.randint(0, 60)) + (third + say(9) if i % 3 == 0 else "")) for i in range(120)]


def test_hot_anchors_by_their_windows(spark, monkeypatch):
    docs = hot_corpus()
    monkeypatch.setattr(repeats, "BLOCK", 4000)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for hot in (30, 10**9):
        monkeypatch.setattr(repeats, "HOT", hot)
        rows = repeats.repeated_spans(df).collect()
        assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == brute(docs)


def test_rows_that_share_an_id(spark):
    docs = [(1, "x" * 60), (1, "x" * 60), (1, "y" * 70 + "x" * 60), (2, "y" * 55), (3, None), (3, "z" * 51)]
    rows = repeats.repeated_spans(spark.createDataFrame(docs, "doc_id long, text string"), keep_text=True).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed) for r in rows) == [(1, 60, 0), (1, 60, 0), (1, 130, 0), (2, 55, 55), (3, 0, 0), (3, 51, 0)]


def test_window_minima():
    rnd = random.Random(12)
    docs = ["".join(rnd.choice("ab") for _ in range(rnd.randint(50, 400))).encode() for _ in range(40)]
    docs += [d[: rnd.randint(50, len(d))] + d for d in docs[:20]]
    snips, places, owners = [], [], []
    for d, r in enumerate(docs):
        text, start, count, _, place, *_ = repeats.snippets([(0, 0, r)])
        snips += [text[s : s + c + 49] for s, c in zip(start, count)]
        places += place.tolist()
        owners += [100 - d] * len(start)
    out, base = repeats.window_minima(snips, np.array(places), np.array(owners))
    least = {}
    for s, o in zip(snips, owners):
        for k in range(len(s) - 49):
            least[s[k : k + 50]] = min(o, least.get(s[k : k + 50], o))
    for s, b in zip(snips, base):
        assert [least[s[k : k + 50]] for k in range(len(s) - 49)] == out[b : b + len(s) - 49].tolist()


def test_long_texts_in_parts(monkeypatch):
    monkeypatch.setattr(repeats, "PIECE", 300)
    rnd = random.Random(4)
    raw = [bytes(rnd.choice(b"ab") for _ in range(n)) for n in (49, 50, 900, 300, 2000)]
    seen = set()
    for piece in repeats._pieces(raw):
        text, start, count, anchor, place, doc, offset = repeats.snippets(piece)
        for s, c, p, d, o in zip(start, count, place, doc, offset):
            assert text[s : s + c + 49] == raw[d][o : o + c + 49]
            assert c - 1 <= p <= 50 - repeats.KMER  # all windows hold the anchor
            for k in range(c):
                assert (d, o + k) not in seen
                seen.add((d, o + k))
    assert len(seen) == sum(max(0, len(r) - 49) for r in raw)
