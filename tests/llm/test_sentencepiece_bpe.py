import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import sentencepiece_bpe as own

P = pytest.importorskip("public_tokenizers")
lib = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
T = own.prefix_table(P.path("piece_bpe_32k.model"))
SETS = ["abcdefghijklmnopqrstuvwxyz", "the in an er re on", "éèüöäßñ ABCΣσİ", "!?.,'\"#$%&<>|", "0123456789", "中文日本語한국 ́̈", "\x00\x1c\t\n\x85\xa0  ​😀", "▁ ", "     ", "<s></s><unk><0x41>"]


def texts():
    rnd = random.Random(1)
    out = ["", " ", "  ", "▁", "\n", " a", "a ", "<s>", "<0x0A>", "aaaaaaa", "=" * 77]
    for k in range(500):
        a = "".join(rnd.sample(SETS, rnd.randint(1, 4)))
        out.append("".join(rnd.choice(a) for _ in range(rnd.choice([1, 5, 40, 900]) if k % 5 else 3000)))
    pieces = [p for p, k in zip(T.pieces, T.kinds) if k == own.NORMAL]
    out += ["".join(rnd.choice(pieces) for _ in range(60)) for _ in range(400)]
    return out + ["ha" * 40_000, "word " * 30_000, " " * 10_000 + "x", "x" + "▁" * 999 + "y"]


def test_equals_the_library():
    for t in texts():
        ids = lib.encode(t)
        assert list(T.encode(t)) == ids, repr(t)[:200]
        assert "".join(T.text(ids)) == lib.decode(ids), repr(t)[:200]


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=80))
def test_any_text(t):
    t = t.encode("utf-8", "ignore").decode()
    ids = lib.encode(t)
    assert list(T.encode(t)) == ids and "".join(T.text(ids)) == lib.decode(ids)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, T.size - 1)), max_size=30))
def test_any_ids(ids):
    assert "".join(T.text(ids)) == lib.decode(ids)


def test_each_prefix_has_one_last_token():
    rnd = random.Random(2)
    for _ in range(60):
        s = own.SPACE + "".join(rnd.choice("theinanerr") for _ in range(30))
        tokens = T.segment_tokens(s)
        assert "".join(T._string(x) for x in tokens) == s
        for end in range(1, len(s) + 1):
            fitting = [i for at, i in T.automaton.iter(s[:end]) if at == end - 1 and T._fits(-1 if len(T.pieces[i]) == end else T.segment_tokens(s[: end - len(T.pieces[i])])[-1], i)]
            assert fitting == [T.segment_tokens(s[:end])[-1]]


def test_memory_does_not_matter(monkeypatch):
    some = texts()[:150]
    want = [own._digests(T, t) for t in some]
    monkeypatch.setattr(own, "REMEMBERED", 3)
    T.known.clear()
    T.fits.clear()
    assert [own._digests(T, t) for t in some] == want


def test_digests_and_columns(spark):
    some = [(i, t, "x") for i, t in enumerate([*texts()[:80], texts()[-1]])] + [(None, "null id", "x"), (3, "again", "x"), (3, "again", "x"), (90, None, None)]
    df = spark.createDataFrame(some, "doc_id long, text string, n_tokens string")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    rows = own.piece_digests(df, own.model()).collect()
    assert len(rows) == len(some)
    for r, (i, t, _) in zip(rows, some):
        ids = lib.encode(t or "")
        assert tuple(r) == (i, len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids)))
    assert own.piece_digests(df.limit(0), own.model()).count() == 0


def test_round_trip_and_clashing_names(spark):
    df = spark.createDataFrame([(1, " hello  world\n", "x", "y"), (2, None, "x", "y")], "doc_id long, text string, ids string, decoded string")
    out = own.piece_encode(df, own.model())
    assert out.columns == [*df.columns, "_ids"] and [r.ids for r in out.collect()] == ["x", "x"]
    back = own.piece_decode(out, own.model(), ids_col="_ids")
    assert back.columns == [*out.columns, "_decoded"] and [r._decoded for r in back.collect()] == [" hello  world\n", ""]


def test_query_over_documents(spark):
    rows = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = own.op11_sentencepiece(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(rows)
    for r in got:
        ids = lib.encode(rows[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()


def test_other_models_are_refused(tmp_path):
    data = open(own.model(), "rb").read()
    (tmp_path / "m").write_bytes(data.replace(b"\x0a\x08identity\x12\x00\x18\x01", b"\x0a\x08identity\x12\x00\x18\x00"))
    with pytest.raises(ValueError):
        own.PrefixTable(str(tmp_path / "m"))
