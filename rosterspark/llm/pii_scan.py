"""Personal data by weak supervision: labelers vote on candidate spans, expectation-maximisation weighs them, a classifier decides.

Base spans (addresses, numbers) come from fixed patterns and always stay. Further candidates (addresses spelt out,
telephone numbers without a country, bank accounts, social security numbers) come from wider patterns. On every span
six labelers vote for, against or not at all: its shape, its checksum or range, gazetteers (domains, calling codes, issuers,
countries), words before it for and against, and its bounds. A span's votes and a few bits of its form are one small
code, so the corpus is counted whole, as (kind, code, count), a table of bounded size. From it expectation-maximisation
estimates each labeler's reliability without any labels, and a logistic regression is trained on the resulting
probabilities. Further candidates that it gives at least one half are added.

Texts are read once; what is written, counted and scored afterwards holds spans only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import in_parts, materialize

#: Kinds in the order in which they are listed: the base ones, then the further ones.
BASE_KINDS, MORE_KINDS = ("email", "ip", "card", "phone"), ("mail", "tel", "iban", "ssn")
KINDS = BASE_KINDS + MORE_KINDS
LABELERS = ("shape", "checksum", "gazetteer", "near", "against", "bounds")
FORMS = 8
SPANS = "array<struct<kind:int,start:int,end:int,code:int>>"

# Base patterns. A run of digits is only entered at its start: a match there ends where one from its middle would.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
# Further candidates.
MAIL = re.compile(r"[A-Za-z0-9._-]{1,64}(?:\x20?[\[(]at[\])]\x20?|\x20at\x20)[A-Za-z0-9-]{1,63}(?:(?:\x20?[\[(]dot[\])]\x20?|\x20dot\x20)[A-Za-z0-9-]{1,63}){1,4}")
TEL = re.compile(r"(?<![0-9A-Za-z+(.=_/-])(?:\([0-9]{2,5}\)\x20?|0[0-9]{1,4}[\x20/-])[0-9]{3,4}[\x20-][0-9]{3,5}(?![0-9A-Za-z_-])")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")

# Gazetteers, and words before a span that speak for its kind or against any.
DOMAINS = frozenset("com org net edu gov io info biz me eu uk de fr es it nl be ch at pt pl se no dk fi ie ru us ca mx br ar jp cn in au nz za".split())
CALLING = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 351 352 353 358 420 421 971 972".split())
COUNTRIES = frozenset("AD AE AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IS IT LI LT LU LV MC MT NL NO PL PT RO SE SI SK SM TR".split())
ISSUERS = frozenset("3456")
ADDRESS, NUMBER = r"mail|contact|write to|reach", r"phone|\btel\b|call|mobile|fax|dial|\bcell"
NEAR = {
    "email": ADDRESS, "ip": r"\bip\b|host|server|address|login|client", "card": r"card|visa|credit|amex|payment", "phone": NUMBER,
    "mail": ADDRESS, "tel": NUMBER, "iban": r"iban|bank|account|konto|cuenta|compte", "ssn": r"\bssn\b|social security|taxpayer",
}
NEAR = {k: re.compile(p) for k, p in NEAR.items()}
AGAINST = re.compile(r"(?:version|release|build|isbn|issn|\bdoi\b|order|invoice|ticket|serial|part|model|chapter|section|figure|\bref\b|\bsku\b|\bid\b|\bno\b)[\s.:#]*$")
NEAR_CHARS, AGAINST_CHARS = 48, 16


def luhn(digits: str) -> bool:
    twice = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in twice)) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost, non-overlapping: from the start of the run before the sign, or from the end of the match before."""
    last = 0
    for m in DOMAIN.finditer(text):
        low = m.start()
        while low > last and text[low - 1] in LOCAL:
            low -= 1
        if low < m.start():
            yield low, m.end()
            last = m.end()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base kinds, by kind, then start."""
    found = [(0, *s) for s in emails(text)] if "@" in text else []
    if not DIGIT.search(text):
        return found
    found += [(1, *m.span()) for m in IP.finditer(text) if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split("."))] if "." in text else []
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append((2, *m.span()))
    if "+" in text:
        found += [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return found


def more_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the further candidates, by kind, then start; spelt addresses and numbers that meet a base span are left out."""
    found = []
    if "dot" in text and "at" in text:
        found += [(4, *m.span()) for m in MAIL.finditer(text)]
    if DIGIT.search(text):
        found += [(5, *m.span()) for m in TEL.finditer(text)]
        found = [f for f in found if not any(f[1] < e and s < f[2] for _, s, e in base)] if base else found
        found += [(6, *m.span()) for m in IBAN.finditer(text)] + [(7, *m.span()) for m in SSN.finditer(text)]
    return found


def _mod97(text: str) -> bool:
    moved = text[4:] + text[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def votes(kind: str, text: str, start: int, end: int) -> tuple[int, ...]:
    """Each labeler's vote on a span: 1 for, -1 against, 0 none."""
    span, before = text[start:end], text[max(0, start - NEAR_CHARS) : start].lower()
    digits = "".join(c for c in span if c.isdigit())
    shape, checksum, gazetteer = 0, 0, 0
    if kind in ("email", "mail"):
        domain = re.split(r"[.\x20\])]+", span)[-1].lower()
        shape = 1 if domain.isalpha() and 2 <= len(domain) <= (4 if kind == "mail" else 10) else -1
        gazetteer = 1 if domain in DOMAINS else -1
    elif kind == "ip":
        parts = span.split(".")
        shape = 1 if all(p == "0" or p[0] != "0" for p in parts) else -1
        checksum = -1 if int(parts[0]) in (0, 127) or int(parts[0]) >= 224 else 0
    elif kind == "card":
        shape = 1 if len(digits) in (15, 16) and len(set(re.sub("[0-9]", "", span))) <= 1 else -1
        checksum, gazetteer = 1 if luhn(digits) else -1, 1 if digits[0] in ISSUERS else -1
    elif kind in ("phone", "tel"):
        shape = 1 if 10 <= len(digits) <= 13 else -1
        gazetteer = 0 if kind == "tel" else 1 if any(digits[:n] in CALLING for n in (1, 2, 3)) else -1
    elif kind == "iban":
        plain = span.replace(" ", "")
        shape, checksum, gazetteer = 1 if 15 <= len(plain) <= 34 else -1, 1 if _mod97(plain) else -1, 1 if plain[:2] in COUNTRIES else -1
    else:
        shape, checksum = 1, -1 if span[:3] in ("000", "666") or span[0] == "9" or span[4:6] == "00" or span[7:] == "0000" else 1
    near, against = 1 if NEAR[kind].search(before) else 0, -1 if AGAINST.search(before[-AGAINST_CHARS:]) else 0
    sides = text[start - 1 : start] + text[end : end + 1]
    bounds = -1 if any(c.isalnum() or c in "_=\"'/\\-" for c in sides) else 1
    return shape, checksum, gazetteer, near, against, bounds


def code_of(given: tuple[int, ...], span: str) -> int:
    """Votes and form (separators, and digits in fives) of a span as one small number."""
    digits = sum(c.isdigit() for c in span)
    form = (min(digits // 5, 3) << 1) | any(c in " -().[]" for c in span)
    code = 0
    for v in given:
        code = code * 3 + v + 1
    return code * FORMS + form


def parts_of(code: int) -> tuple[tuple[int, ...], int]:
    """The votes and the form that ``code_of`` has made a number of."""
    rest, form = divmod(code, FORMS)
    given = []
    for _ in LABELERS:
        rest, v = divmod(rest, 3)
        given.append(v - 1)
    return tuple(reversed(given)), form


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) of each row of ``docs(doc_id, text)``: base spans and further candidates with their codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("code", pa.int32())]))
        for b in in_parts(batches):
            found = []
            for t in b.column(1):
                text = t.as_py() or ""
                base = base_spans(text)
                found.append([{"kind": k, "start": s, "end": e, "code": code_of(votes(KINDS[k], text, s, e), text[s:e])} for k, s, e in base + more_spans(text, base)])
            yield pa.record_batch([b.column(0), pa.array(found, kind)], names=["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, spans {SPANS}")


class Reliabilities(NamedTuple):
    """The share of personal data by kind, and by labeler, truth (no, yes) and vote (against, none, for) the chance of that vote."""

    prior: np.ndarray
    chance: np.ndarray


#: What reliabilities are before anything is counted, and the rows that this counts as; rounds.
FIRST_CHANCE, FIRST_ROWS, ROUNDS = np.array([[0.45, 0.4, 0.15], [0.15, 0.4, 0.45]]), 20.0, 200


def posterior(kinds: np.ndarray, given: np.ndarray, model: Reliabilities) -> np.ndarray:
    """The probability that each span is personal data, of its votes."""
    log = np.log(model.chance)
    odds = np.log(model.prior[kinds]) - np.log1p(-model.prior[kinds])
    for i in range(given.shape[1]):
        odds = odds + log[i, 1, given[:, i] + 1] - log[i, 0, given[:, i] + 1]
    return 1 / (1 + np.exp(-np.clip(odds, -60, 60)))


def reliabilities(kinds: np.ndarray, given: np.ndarray, counts: np.ndarray) -> Reliabilities:
    """Expectation-maximisation over votes (rows of -1, 0, 1) with their counts, from labelers that are right more often than wrong."""
    n = given.shape[1]
    model = Reliabilities(np.full(len(KINDS), 0.5), np.repeat(FIRST_CHANCE[None], n, axis=0))
    for _ in range(ROUNDS):
        yes = posterior(kinds, given, model) * counts
        no = counts - yes
        prior = (np.bincount(kinds, yes, len(KINDS)) + 0.5 * FIRST_ROWS) / (np.bincount(kinds, counts, len(KINDS)) + FIRST_ROWS)
        chance = FIRST_CHANCE[None] * FIRST_ROWS + np.array([[np.bincount(given[:, i] + 1, w, 3) for w in (no, yes)] for i in range(n)])
        after = Reliabilities(prior, chance / chance.sum(axis=2, keepdims=True))
        done = np.abs(after.chance - model.chance).max() < 1e-9
        model = after
        if done:
            break
    return model


def features(kinds: np.ndarray, given: np.ndarray, forms: np.ndarray) -> np.ndarray:
    """What the classifier sees: the kind, each vote for and against, and the form."""
    parts = [kinds[:, None] == np.arange(len(KINDS)), given == 1, given == -1, (forms >> 1)[:, None] == np.arange(4), (forms & 1)[:, None]]
    return np.hstack(parts).astype(float)


def train_classifier(x: np.ndarray, target: np.ndarray, counts: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic regression on probabilities as targets, by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (counts * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (counts * (p - target)) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


class Model(NamedTuple):
    reliabilities: Reliabilities
    weights: np.ndarray


def train(found: DataFrame) -> Model:
    """The model of all spans of ``candidates``. The driver gets a row for each kind and code: 46,656 at most."""
    rows = found.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.code").agg(F.count(F.lit(1)).alias("n")).orderBy("kind", "code").collect()
    kinds, counts = np.array([r["kind"] for r in rows], int), np.array([r["n"] for r in rows], float)
    parts = [parts_of(r["code"]) for r in rows]
    given, forms = np.array([p[0] for p in parts], int).reshape(-1, len(LABELERS)), np.array([p[1] for p in parts], int)
    model = reliabilities(kinds, given, counts)
    return Model(model, train_classifier(features(kinds, given, forms), posterior(kinds, given, model), counts))


def score(kinds: list[int], codes: list[int], model: Model) -> np.ndarray:
    parts = [parts_of(c) for c in codes]
    given, forms = np.array([p[0] for p in parts], int).reshape(-1, len(LABELERS)), np.array([p[1] for p in parts], int)
    return 1 / (1 + np.exp(-np.clip(features(np.array(kinds, int), given, forms) @ model.weights, -30, 30)))


def pii_scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id and findings (kind, start, end, probability) of each row of ``docs(doc_id, text)``; offsets are code points.

    Findings are all base spans, and further candidates that the classifier gives at least one half, by kind as in
    ``KINDS``, then start. Without ``model`` one is trained on all spans of ``docs``.

    A null text counts as empty and has no findings. A text of any length is read once, in time in proportion to it.
    Repeated rows come out once each. Other columns are ignored. An empty table gives an empty result.
    """
    found = materialize(candidates(docs), "pii-candidates")
    model = model or train(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())]))
        for b in in_parts(batches):
            rows = b.column(1).to_pylist()
            flat = [s for r in rows for s in r]
            chances = iter(score([s["kind"] for s in flat], [s["code"] for s in flat], model) if flat else ())
            kept = []
            for r in rows:
                scored = [(s, float(next(chances))) for s in r]
                kept.append([{"kind": KINDS[s["kind"]], "start": s["start"], "end": s["end"], "probability": p} for s, p in scored if s["kind"] < len(BASE_KINDS) or p >= 0.5])
            yield pa.record_batch([b.column(0), pa.array(kept, kind)], names=["doc_id", "findings"])

    out = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, findings array<struct<kind:string,start:int,end:int,probability:double>>"
    return found.mapInArrow(run, out)


def digest_columns(scanned: DataFrame) -> DataFrame:
    """n_email, n_ip, n_card, n_phone, base_sha256 and spans of findings."""

    def joined(findings: Column) -> Column:
        return F.array_join(F.transform(findings, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")

    count = lambda k: F.size(F.filter("findings", lambda f: f["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("findings", lambda f: f["kind"].isin(*BASE_KINDS))
    return scanned.select("doc_id", *(count(k) for k in BASE_KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("findings")).alias("spans"))
