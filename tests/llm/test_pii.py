import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rosterspark.llm import pii_scan

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def checksum(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (i % 2 + 1)
        total += d // 10 + d % 10
    return total % 10 == 0


def counts(kind, match):
    digits = re.sub("[^0-9]", "", match)
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in match.split(".")), "card": 13 <= len(digits) <= 19 and checksum(digits), "phone": 9 <= len(digits) <= 15}[kind]


def plain(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PLAIN.items() for m in re.finditer(p, text) if counts(k, m[0])]


def base(text):
    return [f"{pii_scan.KINDS[k]}:{s}:{e}" for k, s, e in pii_scan.base_spans(text)]


@settings(max_examples=1500, deadline=None)
@given(st.text("ab.@+-0149 ()é\n%_", max_size=60))
def test_base_spans_equal_plain_patterns(text):
    assert base(text) == plain(text)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["a@b.c", "@", "x.y@d-e.fr", "10.0.0.1", "256.1.1.1", "1.2.3.4.5.6.7.8", "4845168114407329", "4845 1681 1440 7329", "4845168114407328", "+1 (017) 555-7713", "+49 30 1234567", "+1", ".", " ", "-", "é", "00.0.0.0255"]), max_size=12))
def test_joined_spans_equal_plain_patterns(parts):
    assert base("".join(parts)) == plain("".join(parts))


def test_long_texts_take_linear_time():
    for text in ("1" * 400_000, "a" * 400_000 + "@", "a" * 400_000, "1." * 200_000, "+1" * 200_000, "a@b." * 100_000, "+1" + " " * 400_000, "1 " * 200_000, "x at y dot " * 30_000):
        found = pii_scan.base_spans(text)
        pii_scan.more_spans(text, found)
    assert base("a" * 10_000 + "@b.c") == ["email:0:10004"]


def scanned(docs, **kw):
    return pii_scan.digest_columns(pii_scan.pii_scan(docs, **kw))


def check(rows, texts):
    for r in rows:
        wanted = plain(texts[r.doc_id])
        kinds = [w.split(":")[0] for w in wanted]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(map(kinds.count, PLAIN))
        assert r.base_sha256 == hashlib.sha256(",".join(wanted).encode()).hexdigest()
        assert [s for s in r.spans.split(",") if s.split(":")[0] in PLAIN] == wanted


def test_whole_table(spark, small):
    """Base spans everywhere; texts of this table have nothing else, so nothing may be added to them."""
    texts = {r.doc_id: r.text or "" for r in small("documents").collect()}
    rows = scanned(small("documents")).collect()
    assert len(rows) == len(texts) and any(r.spans for r in rows)
    check(rows, texts)
    assert all(r.spans == ",".join(plain(texts[r.doc_id])) for r in rows)


def test_odd_rows(spark, odd_docs, no_docs):
    assert scanned(odd_docs).count() == odd_docs.count() and scanned(no_docs).isEmpty()
    assert all(r.spans == "" for r in scanned(odd_docs).collect())


PERSONAL = [
    "Please call (030) 555-1234 now.", "Her telephone is 0171 555 12345.", "mail john.smith at example dot com please", "write to anna [at] firma [dot] de", "IBAN DE89 3704 0044 0532 0130 00",
    "bank account GB29NWBK60161331926819.", "Her SSN is 123-45-6789.", "social security number 219-09-9999", "Mobile (0171) 555-9876",
]
CLEAN = ["model 000-45-6789", "part no. 987-65-4321", "serial AB12 3456 7890 1234", "order ZZ99ABCD12345678", "look at the dot matrix", "x=0123 456-7890y", "We met at noon dot", "See figure 666-12-0000."]


def test_added_spans(spark, small):
    rows = [(i, t) for i, t in enumerate(PERSONAL + CLEAN)]
    found = {r.doc_id: r.spans for r in scanned(spark.createDataFrame(rows, "doc_id long, text string").union(small("documents").select(F.col("doc_id") + 1000, "text"))).collect()}
    assert [t for i, t in rows[: len(PERSONAL)] if not found[i]] == []
    assert [t for i, t in rows[len(PERSONAL) :] if found[i]] == []


def test_codes():
    for votes in ((1, 1, 1, 1, 1, 1), (-1, 0, 1, 0, -1, 1), (-1,) * 6):
        for span in ("a@b.c", "4845 1681 1440 7329"):
            votes_back, form = pii_scan.parts_of(pii_scan.code_of(votes, span))
            assert votes_back == votes and 0 <= form < pii_scan.FORMS


def test_reliabilities_are_recovered():
    """Votes drawn from known labelers; one of them is hardly better than chance, one votes rarely."""
    draw = np.random.default_rng(1)
    n, kinds = 60_000, draw.integers(0, 2, 60_000)
    truth = draw.random(n) < np.where(kinds == 0, 0.7, 0.3)
    right, speaks = np.array([0.95, 0.85, 0.8, 0.55, 0.9, 0.75]), np.array([0.9, 0.9, 0.8, 0.9, 0.2, 0.7])
    hits = np.where(draw.random((n, 6)) < right, truth[:, None], ~truth[:, None])
    given_votes = np.where(draw.random((n, 6)) < speaks, hits * 2 - 1, 0)
    model = pii_scan.reliabilities(kinds, given_votes, np.ones(n))
    assert np.abs(model.prior[:2] - [0.7, 0.3]).max() < 0.03
    assert np.abs(model.chance[:, 1, 2] - right * speaks).max() < 0.03 and np.abs(model.chance[:, 0, 0] - right * speaks).max() < 0.03
    p = pii_scan.posterior(kinds, given_votes, model)
    w = pii_scan.train_classifier(pii_scan.features(kinds, given_votes, np.zeros(n, int)), p, np.ones(n))
    guess = pii_scan.features(kinds, given_votes, np.zeros(n, int)) @ w >= 0
    assert ((p >= 0.5) == truth).mean() > 0.93 and (guess == truth).mean() > 0.93
