import hashlib
import re

from kinfold.llm.pii import BASE, KINDS, LABELERS, estimate, find_personal_data, fit, op2_weak_supervision
from tests.llm.helpers import DOCS, odd_rows, table

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def sound(kind, v):
    d = [int(c) for c in v if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in v.split("."))
    if kind == "card":
        return 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))) % 10 == 0
    return kind != "phone" or 9 <= len(d) <= 15


def plain_base(t):
    return [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, t or "") if sound(k, m[0])]


def check(rows, docs):
    want = sorted((str(d), hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in plain_base(t)).encode()).hexdigest(), *[sum(s[0] == k for s in plain_base(t)) for k in BASE]) for d, t in docs)
    assert sorted((str(r.doc_id), r.base_sha256, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in rows) == want
    text = {}
    for d, t in docs:
        text.setdefault(d, []).append(t)
    for r in rows:
        spans = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in r.spans.split(",") if s)]
        assert [KINDS.index(s[0]) for s in spans] == sorted(KINDS.index(s[0]) for s in spans)
        assert any([s for s in spans if s[0] in BASE] == plain_base(t) for t in text[r.doc_id])


def test_documents(spark, sf):
    check(op2_weak_supervision(spark, sf).collect(), [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])


AWKWARD = [
    "a@b.c._x@y.z a@b@c.d x..y@z.com. é\U0001f600 me+tag@mail.example.org,q@q", "1.2.3.4.5.6.7.8 300.1.1.1.5 0001.02.3.0255 1..2.3.4.5 99999999999999999999.1.1.1",
    "4111 1111 1111 1111 4111-1111-1111-1111x 41111111111111110 4111  1111 1111 1111 1 2 3", "+1 (988) 555-2485. +1-2 +12 34 56 78 9( +1 +2 +49 (0)30 1234567--8",
    "9" * 3000 + " " + "1 " * 3000 + "a@" + ".b" * 4000, "a" * 20000 + " x@" + "y." * 3000 + "z", "+1" + " " * 20000 + "+2" + "(" * 9000, "1." * 6000,
    "5500-0000-0000-0004 378282246310005 30569309025904 6011111111111117-", "4111 1111 1111 1111 2222 3333 4444",
]


def test_awkward_and_odd_rows_and_empty(spark, tmp_path):
    rows = [*odd_rows(), *((100 + i, t, "en", "a", 1, 1, "x") for i, t in enumerate(AWKWARD))]
    check(op2_weak_supervision(spark, table(spark, tmp_path, "documents", rows)).collect(), [(r[0], r[1]) for r in rows])
    assert op2_weak_supervision(spark, table(spark, tmp_path / "e", "documents", [], DOCS)).count() == 0


def test_added_spans_are_judged_by_the_votes(spark, tmp_path):
    good = [f"call me: ({300 + i}) 555-{1000 + i}, signed Mary Wilson. ssn 523-45-{1000 + i} mail a{i}@b.com" for i in range(30)]
    bad = [f"part x000-00-{1000 + i}y of build x{100 + i} 555 1234x" for i in range(10)]
    rows = [(i, t, "en", "a", 1, 1, "x") for i, t in enumerate(good + bad)]
    out = {r.doc_id: r.spans for r in op2_weak_supervision(spark, table(spark, tmp_path, "documents", rows)).collect()}
    assert all("phone_local:9:23" in out[i] and "name:" in out[i] and "national_id:" in out[i] for i in range(30))
    assert all(out[i] == "" for i in range(30, 40))


def test_em_finds_the_reliable_labelers():
    import random

    rng, counts = random.Random(0), {}
    reliability = [0.95, 0.9, 0.6, 0.85, 0.55, 0.8]
    for _ in range(4000):
        truth = 1 if rng.random() < 0.4 else -1
        vote = tuple(0 if rng.random() < 0.2 else truth if rng.random() < r else -truth for r in reliability)
        counts[vote] = counts.get(vote, 0) + 1
    patterns = [("name", v, c) for v, c in sorted(counts.items())]
    right, share, post = estimate(patterns)
    assert all(abs(a - b) < 0.06 for a, b in zip(right, reliability)) and abs(share["name"] - 0.4) < 0.05
    assert len(right) == len(LABELERS)


def test_places_are_weighed_by_their_odds():
    weight = fit([(0, 90 * 10**6, 10**6), (1, 50 * 10**6, 50 * 10**6), (2, 10**6, 90 * 10**6)], (150 * 10**6, 150 * 10**6))
    assert weight[0] > 3 and abs(weight[1]) < 1e-9 and weight[2] < -3 and weight[3] == 0


def test_secrets_keys_and_account_numbers(spark, tmp_path):
    good = [f"use token = \"{i:02d}be64439e3e49cf46b2d7c90f3602a3\" or key AKIA{i:02d}ABCDEFGHIJKLMN then pay DE89 3704 0044 0532 0130 00 now" for i in range(20)]
    clean = [f"the token of trust number {i} and DE12 3456 7890 1234 5678 90 the secret: no" for i in range(20)]
    rows = [(i, t, "en", "a", 1, 1, "x") for i, t in enumerate(good + clean)]
    out = {r.doc_id: r for r in op2_weak_supervision(spark, table(spark, tmp_path, "documents", rows)).collect()}
    for i in range(20):
        kinds = {s.split(":")[0] for s in out[i].spans.split(",")}
        assert kinds == {"secret", "key", "iban"} and out[i].n_spans == 3 and out[i].personal
        assert out[20 + i].spans == "" and not out[20 + i].personal


def test_planted_texts_are_found_and_clean_ones_left(spark):
    sf = "/root/testdata/sf0.01"
    text = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = {r.doc_id: r.personal for r in op2_weak_supervision(spark, sf).collect()}
    planted = {d for d, t in text.items() if plain_base(t) or re.search("token = \"[0-9a-f]{20,}", t)}
    assert planted and all(out[d] for d in planted) and not any(out[d] for d in out if d not in planted)


def test_many_matches_in_one_text(spark):
    import time

    def took(n):
        df = spark.createDataFrame([(1, " ".join(f"é a{i}@b.com" for i in range(n)) + " call: 300-555-1234")], "doc_id long, text string")
        start = time.time()
        spans = find_personal_data(df).first().spans
        assert len(spans) >= n and [s.start for s in spans[:3]] == [2, 13, 24]
        return time.time() - start

    took(100)
    few, many = took(100), took(16_000)
    assert many < few + 6
