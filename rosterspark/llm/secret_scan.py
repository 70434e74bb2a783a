r"""Secret scan over an incremental blob ledger, in DataFrame functions only.

Every version of a text is content-addressed: its blob is the SHA-256 of its text. The ledger holds one row for each
(blob, rule version) that has been scanned, with all findings. A scan takes the blobs that the ledger lacks under the
current rule version, each once however many paths carry it, and appends them; findings then join back to every path.
Only digests are grouped. A text moves only if a cheap pattern says that it may hold a secret; other blobs enter the
ledger without findings.

Positions come from SQL alone: ``split`` gives the stretches between matches and ``regexp_extract_all`` the matches,
so running sums of their lengths (in code points) are the spans.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize, new_path, path_exists, split_by_slots, text_or_empty


class Rule(NamedTuple):
    """A pattern; a match counts if its group ``group`` has at least ``least`` characters. ``hint`` is a cheap pattern that every text with a match also matches."""

    kind: str
    pattern: str
    group: int
    least: int
    hint: str


def either_case(words: str) -> str:
    """A pattern with each letter in either case, of ASCII alone (case folding in some engines adds letters)."""
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in words)


KEYWORDS = either_case("(password|passwd|secret|token|api_?key)")
#: The base rules, in the order in which kinds are listed at equal starts, then the rules that this library adds. Runs of
#: digits and letters are matched in whole, so a least length in the pattern finds what dropping shorter runs would leave.
BASE_RULES = (
    Rule("assign", rf"""{KEYWORDS}["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, rf"""{either_case("(?:password|passwd|secret|token|api_?key)")}["']?\x20*[:=]"""),
    Rule("access", r"AKIA[A-Z0-9]{16,}", 0, 0, r"AKIA"),
    Rule("hex", r"[0-9a-f]{24,}", 0, 0, r"[0-9a-f]{24}"),
)
EXTRA_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END [A-Z ]*PRIVATE KEY-----)?", 0, 0, r"-----BEGIN [A-Z ]*PRIVATE KEY"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0, r"eyJ[A-Za-z0-9_-]{8}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 0, r"gh[pousr]_[A-Za-z0-9]{36}"),
)
RULES = BASE_RULES + EXTRA_RULES
FINDINGS = "array<struct<start:int,ord:int,kind:string,end:int>>"
LEDGER = f"blob string, rule_version string, findings {FINDINGS}"


#: Raised whenever spans are found in another way under the same rules, so that ledgers scan anew; and characters of a chunk in which a cut is looked for.
FINDER, CHUNK = 2, 1024


def rule_version(rules: tuple[Rule, ...] = RULES) -> str:
    return hashlib.sha256(repr([FINDER, *(tuple(r) for r in rules)]).encode()).hexdigest()[:16]


def _steps(text: Column, rule: Rule) -> Column:
    """Array of (gap, size, counted): the lengths of the stretch before each match of a rule, of the match, and of what must be long enough."""
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    counted = whole if rule.group == 0 else F.regexp_extract_all(text, pattern, F.lit(rule.group))
    gaps = F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(whole))
    steps = F.arrays_zip(F.transform(gaps, F.length).alias("gap"), F.transform(whole, F.length).alias("size"), F.transform(counted, F.length).alias("counted"))
    kind = "array<struct<gap:int,size:int,counted:int>>"
    return F.when(text.rlike(rule.hint), steps.cast(kind)).otherwise(F.array().cast(kind))


def find_secrets(texts: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, findings) of the ``texts(blob, text)`` that have any: array of (start, ord, kind, end), by start, then by the order of the rules.

    Matches become rows, and their places running sums over the rows of a text, so the work is linear in its findings.
    """
    found = F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(r.kind).alias("kind"), F.lit(r.least).alias("least"), _steps(F.col("text"), r).alias("steps")) for i, r in enumerate(rules)))
    rows = texts.select("blob", F.explode(found).alias("r")).select("blob", "r.ord", "r.kind", "r.least", F.posexplode("r.steps").alias("pos", "m")).repartition("blob")
    upto = Window.partitionBy("blob", "ord").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    ends = rows.withColumn("end", F.sum(F.col("m.gap") + F.col("m.size")).over(upto).cast("int")).where("m.counted >= least")
    span = F.struct((F.col("end") - F.col("m.size")).alias("start"), "ord", "kind", "end")
    return ends.groupBy("blob").agg(F.sort_array(F.collect_list(span)).alias("findings"))


def blob_of(text: Column) -> Column:
    return F.sha2(text, 256)


def scan_blobs(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Bring the ledger at path ``ledger`` up to date with ``versions(text)`` and return its rows for these rules, one a blob.

    Only blobs without a row for this rule version are scanned, each once. Rows are appended, never rewritten; a task
    that is repeated leaves no second row, as only its last attempt is committed. Writers that meet may both add a
    blob, with the same findings; readers take one.
    """
    spark, version = versions.sparkSession, rule_version(rules)
    rows = versions.select(text_or_empty().alias("text"))
    blobs = rows.select(blob_of(F.col("text")).alias("blob")).distinct()
    known = path_exists(spark, ledger)
    if known:
        done = spark.read.schema(LEDGER).parquet(ledger).where(F.col("rule_version") == version).select("blob")
        blobs = blobs.join(done, "blob", "left_anti")
    unseen = materialize(blobs, "unseen-blobs")
    if not known or not unseen.isEmpty():
        hinted = reduce(Column.__or__, (F.col("text").rlike(r.hint) for r in rules))
        texts = rows.where(hinted).withColumn("blob", blob_of(F.col("text"))).join(unseen, "blob", "left_semi").dropDuplicates(["blob"])
        found = materialize(find_secrets(texts, rules), "found-blobs")
        none = F.array().cast(FINDINGS)
        full = unseen.join(found, "blob", "left").select("blob", F.lit(version).alias("rule_version"), F.coalesce("findings", none).alias("findings"))
        full.write.mode("append").parquet(ledger)
    return spark.read.schema(LEDGER).parquet(ledger).where(F.col("rule_version") == version)


def findings_of(versions: DataFrame, ledger: str | None, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, findings) of the blobs of ``versions(text)`` that have any, as a written table, so that a join with it can split a hot blob."""
    ledger = ledger or new_path(versions.sparkSession, "secret-ledger")
    return materialize(scan_blobs(versions, ledger, rules).where(F.size("findings") > 0).select("blob", "findings").dropDuplicates(["blob"]), "findings")


def secret_scan(docs: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The ``keys``, blob and findings of each row of ``docs(doc_id, text)``; without ``ledger`` a new one in the shared folder.

    ``keys`` name a version: an id, or the path and commit of a file. A null text is the empty blob, which has no
    findings. Repeated rows and equal texts under several keys share one scan and each get a row. Other columns are
    ignored. An empty table gives an empty result.
    """
    found = findings_of(docs.select("text"), ledger, rules)
    paths = docs.select(*keys, blob_of(text_or_empty()).alias("blob"))
    return paths.join(found, "blob", "left").select(*keys, "blob", F.coalesce("findings", F.array().cast(FINDINGS)).alias("findings"))


def digest_columns(scanned: DataFrame) -> DataFrame:
    """n_assign, n_access, n_hex, base_sha256 and spans of findings."""
    base = F.filter("findings", lambda f: f["ord"] < len(BASE_RULES))
    count = lambda k: F.size(F.filter("findings", lambda f: f["kind"] == k)).cast("long").alias(f"n_{k}")
    joined = lambda a: F.array_join(F.transform(a, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")
    return scanned.select("doc_id", *(count(r.kind) for r in BASE_RULES), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("findings")).alias("spans"))


def _marks(found: DataFrame) -> DataFrame:
    """(blob, starts, ends) of (blob, findings): spans that meet or overlap as one, in order."""
    spans = found.select("blob", F.explode("findings").alias("f")).select("blob", "f.start", "f.ord", "f.end").repartition("blob")
    order = Window.partitionBy("blob").orderBy("start", "ord")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    parted = spans.withColumn("apart", F.when(F.col("start") <= reach, 0).otherwise(1))
    numbered = parted.withColumn("mark", F.sum("apart").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    marks = numbered.groupBy("blob", "mark").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    whole = marks.groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("marks"))
    return whole.select("blob", F.col("marks.start").alias("starts"), F.col("marks.end").alias("ends"))


def _cut(chunks: Column, start: Column, end: Column) -> Column:
    """Characters ``start`` to ``end`` of a text given as chunks, looked for in two chunks alone."""
    first, last, off = F.floor(start / CHUNK).cast("int"), F.floor(end / CHUNK).cast("int"), start % CHUNK + 1
    chunk = lambda i: F.coalesce(F.get(chunks, i), F.lit(""))
    between = F.array_join(F.slice(chunks, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
    several = F.concat(F.substring(chunk(first), off, F.lit(CHUNK)), between, F.substring(chunk(last), F.lit(1), end % CHUNK))
    return F.when(first == last, F.substring(chunk(first), off, end - start)).otherwise(several)


def redact(docs: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with every found span of ``text`` replaced by ``[secret]``; all columns and rows stay.

    Spans that meet or overlap become one mark. Null and empty texts stay as they are; repeated rows and equal texts are
    redacted alike. The work is linear in a text and its findings. Columns of any names pass unchanged. An empty table
    gives an empty result. Texts move only where a slot says that they may have findings.
    """
    marks = materialize(_marks(findings_of(docs.select("text"), ledger, rules)), "marks")
    clear, others = split_by_slots(docs.select(F.struct("*").alias("row"), blob_of(text_or_empty()).alias("blob")), marks.select("blob"))
    chunks = F.regexp_extract_all("row.text", F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    joined = others.join(marks.hint("merge"), "blob", "left").withColumn("chunks", F.when(F.col("starts").isNotNull(), chunks))
    froms, upto = F.concat(F.array(F.lit(0)), F.col("ends")), F.concat(F.col("starts"), F.array(F.length("row.text")))
    kept = F.zip_with(froms, upto, lambda a, b: _cut(F.col("chunks"), a, b))
    changed = joined.select("row", F.when(F.col("starts").isNotNull(), F.array_join(kept, "[secret]")).otherwise(F.col("row.text")).alias("clean")).union(clear.select("row", "row.text"))
    return changed.select(*(F.col("clean").alias(c) if c.lower() == "text" else F.col("row")[c].alias(c) for c in docs.columns))
