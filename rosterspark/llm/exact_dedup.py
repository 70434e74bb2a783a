"""Exact deduplication by content-defined chunk recipes, in DataFrame functions only.

Each text is cut where its content says so, from a least length on: at a sentence or line end, else after a word that
ends as few words do, else between characters that seldom meet, so equal texts have equal chunks and an inserted
character moves only the cuts near it. Chunks become identifiers once; after that only lists of identifiers move, never the texts:

1. chunk occurrences: (document, position, 64-bit hash, SHA-256);
2. dictionary: a 64-bit hash is a verified identifier if one SHA-256 stands behind it; where two do, the SHA-256 is
   added to the identifier, so two chunks never share one;
3. recipe: a document's identifiers in order; documents with equal recipes are copies.

Counting uses map-side aggregation. The join on chunks is a plain equi-join that adaptive execution can split, and
groups of copies are joined back by recipe and salt, so a chunk or a group of copies that holds a third of all rows needs
no single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import SALTS, materialize, split_by_slots, text_or_empty

CHUNK_LEAST, CHUNK_MOST = 1024, 8192
#: Rows that one row which stands for repeated ones is first turned into.
REPEATS = 1 << 16


def chunk_pattern(least: int = CHUNK_LEAST, most: int = CHUNK_MOST) -> str:
    """A chunk ends from ``least`` characters on: at the first sentence or line end before twice as many, else at the first
    word end or pair of characters that content marks, at ``most`` at the latest."""
    ends = (r"(?:[.!?][ \n]|[。！？\n])", r"(?:[bcdfgklmprtz][aeiou][ ]|[0-9a-f][g-k]|[A-F][L-P]|[\u4e00-\u50ff])")
    near = min(2 * least, most)
    return rf"(?s).{{{least},{near}}}?{ends[0]}|.{{{least},{most}}}?{ends[1]}|.{{1,{most}}}"


def chunk_occurrences(docs: DataFrame, least: int = CHUNK_LEAST, most: int = CHUNK_MOST) -> DataFrame:
    """(doc_id, text_sha256, pos, hash, digest), a row per chunk; a row with null ``pos`` for an empty text."""
    text = text_or_empty()
    chunks = F.regexp_extract_all(text, F.lit(chunk_pattern(least, most)), F.lit(0))
    return docs.select("doc_id", F.sha2(text, 256).alias("text_sha256"), F.posexplode_outer(chunks).alias("pos", "chunk")).select("doc_id", "text_sha256", "pos", F.xxhash64("chunk").alias("hash"), F.unhex(F.sha2("chunk", 256)).alias("digest"))


def recipes(docs: DataFrame, least: int = CHUNK_LEAST, most: int = CHUNK_MOST) -> DataFrame:
    """(doc_id, text_sha256, recipe, n): a row per distinct (doc_id, text); ``n`` counts the rows that repeat it."""
    found = chunk_occurrences(docs, least, most)
    pairs = found.where("pos is not null").groupBy("hash").agg(F.min("digest").alias("low"), F.max("digest").alias("high"))
    clashes = materialize(pairs.where("low != high").select("hash", F.lit(True).alias("clash")), "clashes")  # hardly ever a row
    ids = found.join(clashes, "hash", "left").select("doc_id", "text_sha256", "pos", F.struct("hash", F.when(F.col("clash"), F.col("digest")).alias("digest")).alias("id"))
    # A document's rows may repeat: the set of (position, identifier) is its recipe, and position 0 counts the rows.
    lists = ids.groupBy("doc_id", "text_sha256").agg(
        F.collect_set(F.when(F.col("pos").isNotNull(), F.struct("pos", "id"))).alias("parts"),
        F.count_if(F.coalesce(F.col("pos"), F.lit(0)) == 0).alias("n"),
    )
    return lists.select("doc_id", "text_sha256", F.transform(F.sort_array("parts"), lambda p: p["id"]).alias("recipe"), "n")


def copies(docs: DataFrame, least: int = CHUNK_LEAST, most: int = CHUNK_MOST) -> DataFrame:
    """doc_id, n, keep_id, group_size, kept, text_sha256: as ``exact_dedup``, but ``n`` counts the rows that repeat both id and text."""
    lists = materialize(recipes(docs.select("doc_id", "text"), least, most).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))), "recipes")
    parts = lists.groupBy("recipe", "salt").agg(F.max("doc_id").alias("most"), F.sum("n").alias("n"))
    groups = parts.groupBy("recipe").agg(F.max("most").alias("keep_id"), F.sum("n").alias("group_size"))
    salted = parts.select("recipe", "salt").join(groups, "recipe")  # a group has at most SALTS rows here
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return lists.join(salted, ["recipe", "salt"]).select("doc_id", "n", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def exact_dedup(docs: DataFrame, least: int = CHUNK_LEAST, most: int = CHUNK_MOST) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of ``docs(doc_id, text)``; other columns are ignored.

    Texts are equal when identical; a null text is empty. Of equal texts the largest ``doc_id`` stays (a null id is the
    smallest). Rows that repeat both id and text come out once each and are kept alike. An empty table gives an empty result.
    """
    found = copies(docs, least, most)
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / REPEATS)))
    rows = found.select("*", blocks.alias("block")).withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(REPEATS).cast("long"), F.col("n") - F.col("block") * REPEATS))))
    return rows.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of ``docs``, all columns, of each group of equal texts: that of the largest ``doc_id``.

    A null text is empty, and a null id the smallest. Of rows that repeat both id and text one stays. Columns of any
    names pass unchanged. An empty table gives an empty result. Ids and digests of rows that go are
    anti-joined; texts move only where a slot says that they may go.
    """
    found = materialize(copies(docs).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.col("doc_id").isNull().alias("no_id"), F.col("text_sha256").alias("sha"), "kept", "n"), "copies")
    keys = ["id", "no_id", "sha"]
    keyed = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.col("doc_id").isNull().alias("no_id"), F.sha2(text_or_empty(), 256).alias("sha"))
    gone = materialize(found.where("not kept").select(*keys), "gone")
    clear, others = split_by_slots(keyed, gone)
    stay = clear.unionByName(others.join(gone.hint("merge"), keys, "left_anti"))
    repeated = materialize(found.where("kept and n > 1").select(*keys), "repeated")
    if not repeated.isEmpty():
        stay = stay.join(repeated, keys, "left_anti").unionByName(stay.join(repeated, keys, "left_semi").dropDuplicates(keys))
    return stay.select("row.*")
