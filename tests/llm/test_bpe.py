import hashlib
import random

import pytest

from ledgerloom.llm import bpe

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def pair():
    path = P.path("word_bpe_49k.json")
    return bpe.transducer(path), tokenizers.Tokenizer.from_file(path)


def texts():
    rnd = random.Random(1)
    sets = ["abcdefghijklmnopqrstuvwxyz", "the in an er re on", "éèüöäßñ ABCΣσİ", "!?.,'\"#$%&", "0123456789", "中文日本語한국 \u0301\u0308", "\x00\x1c\x1f\x85\xa0\u2003 \u200b😀"]
    out = [None, "", " ", "<|endoftext|>", "a<|startoftext|>B's can't <|endoftext|>"]
    for k in range(400):
        a = "".join(rnd.sample(sets, rnd.randint(1, 4)))
        out.append("".join(rnd.choice(a) for _ in range(rnd.choice([1, 5, 40, 900]) if k % 5 else 4000)))
    return out + ["ha" * 60_000, "word " * 30_000]


def test_equals_the_library(pair):
    own, lib = pair
    for t in texts():
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert list(own.encode(t)) == ids, repr(t)[:200]
        assert own.pieces(ids) == lib.decode(ids, skip_special_tokens=False)


def test_windows_do_not_matter(pair, monkeypatch):
    own, _ = pair
    monkeypatch.setattr(bpe, "SLICE", 50)
    monkeypatch.setattr(bpe, "DIRECT", 3)
    for t in texts()[:200]:
        cut = list(own.encode(t))
        monkeypatch.undo()
        assert cut == list(own.encode(t))
        monkeypatch.setattr(bpe, "SLICE", 50)
        monkeypatch.setattr(bpe, "DIRECT", 3)


def test_byte_machine():
    data = "aé中😀".encode() + b"\xff\xe4\xb8"
    for cut in range(len(data)):
        m = bpe.ByteText()
        assert m.feed(data[:cut]) + m.feed(data[cut:]) + m.flush() == data.decode("utf-8", "replace")


def test_digests_and_columns(spark, pair):
    _, lib = pair
    some = [(i, t, "x") for i, t in enumerate(texts()[:60])] + [(None, "null id", "x"), (3, "again", "x")]
    df = spark.createDataFrame(some, "doc_id long, text string, n_tokens string")
    rows = bpe.bpe_digests(df, bpe.vocabulary()).collect()
    assert len(rows) == len(some)
    for r, (i, t, _) in zip(rows, some):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert (r.doc_id, r.n_tokens, r.ids_sha256) == (i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
    assert bpe.bpe_digests(df.limit(0), bpe.vocabulary()).count() == 0
    back = bpe.bpe_decode(bpe.bpe_encode(df.limit(3), bpe.vocabulary()), bpe.vocabulary())
    assert back.columns == [*df.columns, "ids", "decoded"] and back.count() == 3


def test_clashing_names(spark):
    path = bpe.vocabulary()
    df = spark.createDataFrame([(1, "hello world", "x", "y"), (2, None, "x", "y")], "doc_id long, text string, ids string, decoded string")
    out = bpe.bpe_encode(df, path)
    assert out.columns == [*df.columns, "_ids"] and [r.ids for r in out.collect()] == ["x", "x"]
    back = bpe.bpe_decode(out, path, ids_col="_ids")
    assert back.columns == [*out.columns, "_decoded"] and [(r.decoded, r._decoded.strip()) for r in back.collect()] == [("y", "hello world"), ("y", "")]
