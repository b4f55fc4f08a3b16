import hashlib
import math
import random
import re
from collections import Counter

from ledgerloom.llm import secrets

ALLOW = [re.compile(p) for p in secrets.ALLOW]


def brute(text):
    base = []
    for m in re.finditer(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text, re.I | re.A):
        if len(m[2]) >= 12:
            base.append((m.start(), 0, m.end()))
    base += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    base += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    base.sort()
    more, w = [], secrets.WINDOW
    for m in re.finditer(secrets.CANDIDATE, text):
        at, pieces = m.start(), []
        for a, _, z in base:
            if a < m.end() and m.start() < z:
                pieces.append((at, text[at : max(at, a)]))
                at = max(at, z)
        more += [x for a, s in [*pieces, (at, text[at : m.end()])] if len(s) >= w for x in entropy(a, s)]
    join = lambda x: ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in x)
    n = Counter(k for _, k, _ in base)
    return n[0], n[1], n[2], hashlib.sha256(join(base).encode()).hexdigest(), join(sorted(base + more))


def entropy(at, s):
    w = secrets.WINDOW
    words = not re.search("[0-9]", s) and len(re.findall("[a-z](?=[A-Z])", s)) * secrets.CHANGE < len(s)
    if not words and not any(p.search(s) for p in ALLOW):
        limit = secrets.LIMITS["digits" if re.fullmatch("[0-9]+", s) else "hex" if re.fullmatch("[0-9a-fA-F]+", s) else "mixed" if re.search("[0-9]", s) else "letters"]
        hot = [i for i in range(len(s) - w + 1) if -sum(c / w * math.log2(c / w) for c in Counter(s[i : i + w]).values()) >= limit - 1e-9]
        if hot:
            yield at + hot[0], 3, at + hot[-1] + w


def test_against_brute_force(spark, tmp_path):
    rnd = random.Random(5)
    alphabet = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
    parts = ["password", "API_KEY", "token", "secret: ", " = ", "'", '"', ": ", "AKIA", "é😀 ", "the ", "\n", "deadbeef", "0123456789abcdef", "=", "AKIAAKIAAKIA"]
    texts = [None, "", "x", "token: secret: abcdefghijklmnop", "password=abcdefghijk", "password=abcdefghijkl", "AKIA" * 9, "0" * 40, "/usr/local/share/doc/0001", "12345678-1234-1234-1234-123456789abc"]
    for _ in range(400):
        t = ""
        for _ in range(rnd.randint(1, 14)):
            t += rnd.choice(parts) if rnd.random() < 0.6 else "".join(rnd.choice(alphabet if rnd.random() < 0.9 else "0123456789abcdef") for _ in range(rnd.randint(1, 45)))
        texts.append(t)
    texts += [texts[-1], " ".join(["token=abcdefghijklmnop"] * 700)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in secrets.op6_secrets(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i] == brute(t or ""), (i, t)
    assert any("entropy" in g[4] for g in got.values())


def test_shape_of_input(spark):
    df = spark.createDataFrame([(1, "token=abcdefghijklmnop x 0123456789abcdef", [1]), (None, None, None)], "doc_id long, text string, base_spans array<int>")
    out = secrets.secret_spans(df)
    assert out.columns == ["doc_id", "text", "base_spans", "_base_spans", "all_spans"] and out.count() == 2
    assert [r.text for r in secrets.redact_secrets(df).collect()] == ["[secret] x [secret]", None]
    assert secrets.secret_spans(df.limit(0)).count() == 0


def test_second_secret_in_a_run(spark):
    rnd = random.Random(4)
    one = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(40))
    text = "0123456789abcdef" * 2 + "Z" + one
    row = secrets.secret_spans(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [s.kind for s in row.base_spans] == [2] and any(s.kind == 3 and s.start >= 32 for s in row.all_spans)


def test_long_candidate(spark):
    rnd = random.Random(6)
    text = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") for _ in range(100_000))
    row = secrets.secret_spans(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [s.kind for s in row.all_spans if s.kind == 3]


def test_long_repetitions(spark):
    texts = ["usr/" * 100_000 + "Q1x", "a/" * 100_000, "12-" * 100_000 + "7", "Ab" * 100_000, "ab" * 100_000 + "c1", "password=" * 20_000, "AKIA" * 100_000 + "z"]
    got = secrets.secret_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert len(got) == len(texts) and not got[1].all_spans and not got[2].all_spans


def test_secret_without_digits(spark):
    rnd = random.Random(8)
    key = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(40))
    rows = [(1, f"x sk_live_{key} y"), (2, "someLongIdentifierOfAnInterface and ANOTHER_LONG_CONSTANT_NAME_HERE/WithWords"), (3, "just-some-words-with-dashes_and_underscores")]
    got = secrets.secret_spans(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()
    assert [bool(r.all_spans) for r in got] == [True, False, False]
