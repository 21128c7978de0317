import hashlib
import re

import pytest

from quireframe.llm import pii
from quireframe.llm.contract import op4_pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(2 * int(x), 10)) if i % 2 else int(x) for i, x in enumerate(reversed(d))) % 10 == 0


def plain_spans(text):
    out = []
    for kind, p in PLAIN.items():
        for m in re.finditer(p, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                "card": 13 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


def joined(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


TEXTS = [
    "", None, "no data here", "a@b.c_x@y.z and a@b.com@d.org, 😀 x@y.co.uk!", "1.2.3.4.5 999.1.1.1 007.0.0.255 1.2.3 1.2.3.4",
    "card 4111 1111 1111 1111 or 4111-1111-1111-1112 or 4242424242424242", "+1 (652) 555-5229 +44 20 7946 0958. +1 +((( 2", "1" * 20000 + " @ " + "a" * 20000,
    "x@" + "a." * 9000 + "b", "mail me (at) example (dot) com", "@@ a@b a@b. +4111 1111 1111 1111", "a@b.com " * 300, "\n\n a@b.com\n",
]


@pytest.fixture(scope="module")
def model(spark, sf):
    return pii.train(pii.candidates(spark.read.parquet(f"{sf}/documents.parquet")))


def test_base_spans_and_redaction(spark, model):
    rows = [(i, t, len(t or ""), "x") for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, spans string")
    for r in pii.find(pii.candidates(df), model).collect():
        base = [(s.kind, s.start, s.end) for s in r.spans if s.base]
        assert base == plain_spans(TEXTS[r.doc_id]), r.doc_id
        order = [(pii.KINDS.index(s.kind), s.start) for s in r.spans]
        assert order == sorted(order)
    for r in pii.redact(pii.candidates(df), model).collect():
        if TEXTS[r.doc_id] is None:
            assert r.text is None
            continue
        assert not plain_spans(r.text) and r.n_chars == len(r.text)
        if not plain_spans(TEXTS[r.doc_id]):
            assert r.text == TEXTS[r.doc_id] or "[" in r.text
    assert pii.digest(pii.candidates(df.limit(0)), model).count() == 0


def test_query(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op4_pii(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = plain_spans(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(joined(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for x, _, _ in want) for k in PLAIN]
        assert set(joined(want).split(",")) <= set(r.spans.split(","))


def test_training_without_candidates(spark):
    empty = pii.train(pii.candidates(spark.createDataFrame([(1, "nothing"), (2, None)], "doc_id long, text string")))
    assert empty.weights == {}
    got = pii.digest(pii.candidates(spark.createDataFrame([(1, "a@b.com")], "doc_id long, text string")), empty).first()
    assert got.spans == "email:0:7"


def test_em_trusts_the_reliable_labeler(spark):
    rows = [(0, [1, 1, 0, 0, 1, 1], 80), (0, [-1, -1, 0, 0, 1, -1], 80), (0, [-1, -1, 0, 0, -1, -1], 10), (0, [1, 1, 0, 0, -1, 1], 60)]
    got = pii.expectation_maximisation(spark.createDataFrame(rows, "kind int, votes array<int>, n long")).first()
    assert got.accuracy[0] > 0.9 and got.accuracy[4] < 0.7
    assert [round(p.y) for p in sorted(got.patterns, key=lambda p: -p.v[0])] == [1, 1, 0, 0]


def test_weak_labels_reject_secrets_and_take_spelt_out_addresses(spark):
    good = [f"write to user{i}@mail{i % 9}.example.com now" for i in range(60)] + [f"mail jo{i} (at) example (dot) com please" for i in range(20)]
    bad = [f"token={4111111111111112 + i} end" for i in range(60) if not luhn(str(4111111111111112 + i))]
    card = [f"card {c} end" for c in ("4111111111111111", "4242424242424242", "5555555555554444") * 12]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad + card)], "doc_id long, text string")
    model = pii.train(pii.candidates(docs))
    rows = {r.text: [(s.kind, s.base) for s in r.spans] for r in pii.find(pii.candidates(docs), model).collect()}
    assert all(rows[t] == [] for t in bad)
    assert all(rows[t] == [("email", i < 60)] for i, t in enumerate(good))


def test_clashing_names_and_many_matches(spark, model):
    """Columns named as the inner ones, and a text with very many matches."""
    many = "mail a@b.com or 10.0.0.1, " * 1500
    df = spark.createDataFrame([(many, 1, "w", "e", "b", 5), (None, 2, "w", "e", "b", 6)], "text string, doc_id long, whole string, every string, found string, row int")
    got = {r.doc_id: r for r in pii.redact(pii.candidates(df), model).collect()}
    assert got[1].asDict().keys() == set(df.columns) and (got[1].whole, got[1].found, got[2].row, got[2].text) == ("w", "b", 6, None)
    assert got[1].text == "mail [EMAIL] or [IP], " * 1500
    spans = pii.find(pii.candidates(df), model).where("doc_id = 1").first().spans
    assert [(s.kind, s.start, s.end) for s in spans] == plain_spans(many)
