"""The queries of this subpackage and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversation_repair, embedding_dedup, exact_dedup, language_id, license_scan, merkle_manifest, packing, pii_scan, secret_scan, sentencepiece_codec, simhash_dedup, toxicity, warc

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
#: A vocabulary, and the same as ranks.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), RANKS, PATTERN, VOCABULARY)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = sentencepiece_codec.decode(sentencepiece_codec.encode(table(spark, sf_dir, "documents"), PIECE_MODEL), PIECE_MODEL)
    n = (F.octet_length("ids") / 4).cast("long")
    return coded.select("doc_id", n.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.simhash_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_round_trip(table(spark, sf_dir, "pages"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest_columns(secret_scan.secret_scan(table(spark, sf_dir, "documents")))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(table(spark, sf_dir, "documents"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_dedup(table(spark, sf_dir, "embeddings"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = merkle_manifest.merkle_manifest(table(spark, sf_dir, "documents"), merkle_manifest.tampered())
    return made.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle_manifest.proof(F.col("path")), 256).alias("proof_sha256"), "folded_root", "verified")


def op12_pii_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_scan.digest_columns(pii_scan.pii_scan(table(spark, sf_dir, "documents")))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(conversation_repair.damage(table(spark, sf_dir, "conversations")))


def crc32_sql(text: str) -> str:
    """The CRC-32 of ASCII text in SQL, bit by bit."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda c: [ascii(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))"
    step = "lambda a, x: case when x >= 0 then xor(a, x) else xor(a >> 1, 3988292384 * (a & 1)) end"
    return f"xor(list_reduce({steps}, {step}, 4294967295::bigint), 4294967295)"


def merkle_sql() -> str:
    """The manifest in SQL: levels by recursion, then each row's siblings and its fold."""
    field = lambda c: f"coalesce(octet_length(encode({c}::varchar)) || ':' || {c}::varchar, '-')"
    leaf = lambda n: f"sha256({field('doc_id')} || {field('source')} || {field('lang')} || {field(n)} || {field('text')})"
    tree = """
        select {key}0 as lvl, pos, digest, n from {leaves} union all
        select {key}lvl + 1, pos // 2, sha256(digest || coalesce(next, '')), (n + 1) // 2
        from (select *, lead(digest) over (partition by {part} order by pos) as next from {name} where n > 1) where pos % 2 = 0
    """
    return f"""
        with recursive docs as (select *, row_number() over () as r, {leaf("n_chars")} as leaf,
                case when {crc32_sql("doc_id::varchar")} % 7 = 0 then {leaf("(n_chars + 1)")} else {leaf("n_chars")} end as found from documents),
        placed as (select r, doc_id, leaf, found, dense_rank() over (order by lang nulls first) - 1 as tree,
                row_number() over (partition by lang order by doc_id nulls first, leaf, r) - 1 as pos, count(*) over (partition by lang) as n from docs),
        leaves as (select tree, pos, leaf as digest, n from placed),
        nodes(tree, lvl, pos, digest, n) as ({tree.format(key="tree, ", leaves="leaves", part="tree", name="nodes")}),
        subroots as (select tree as pos, digest, count(*) over () as n from nodes where n = 1),
        tops(lvl, pos, digest, n) as ({tree.format(key="", leaves="subroots", part="lvl", name="tops")}),
        below as (select r, nodes.lvl as step, (p.pos >> nodes.lvl) & 1 as odd, s.digest as side
                from placed p join nodes on nodes.tree = p.tree and nodes.pos = p.pos >> nodes.lvl and nodes.n > 1
                left join nodes s on s.tree = p.tree and s.lvl = nodes.lvl and s.pos = xor(nodes.pos, 1)),
        above as (select r, 100 + tops.lvl as step, (p.tree >> tops.lvl) & 1 as odd, s.digest as side
                from placed p join tops on tops.pos = p.tree >> tops.lvl and tops.n > 1
                left join tops s on s.lvl = tops.lvl and s.pos = xor(tops.pos, 1)),
        steps as (select r, row_number() over (partition by r order by step) as i, odd, side from (from below union all from above)),
        folds(r, i, digest) as (select r, 0, found from docs union all
                select f.r, f.i + 1, case when odd = 1 then sha256(side || digest) else sha256(digest || coalesce(side, '')) end
                from folds f join steps s on s.r = f.r and s.i = f.i + 1),
        ends as (select r, max_by(digest, i) as folded_root from folds group by r),
        proofs as (select r, string_agg(side, '' order by i) as proof from steps group by r)
        select doc_id, leaf, subroots.digest as subroot, (select digest from tops where n = 1) as root, sha256(coalesce(proof, '')) as proof_sha256,
               folded_root, folded_root = (select digest from tops where n = 1) as verified
        from placed join subroots on subroots.pos = tree join ends using (r) left join proofs using (r)
    """


def repair_sql() -> str:
    """The forward pass in SQL: a recursion over turns that carries the best (cost, audit, text) of each state."""
    step = lambda a, cost, letter, text, when="true": f"case when {a} is not null and {when} then {{'cost': {a}.cost + {cost}, 'audit': {a}.audit || '{letter}', 'out': {a}.out || {text}}} end"
    best = lambda *ways: f"list_min(list_filter([{', '.join(ways)}], lambda w: w is not null))"
    written = lambda role, text: f"chr(10) || {role} || ':' || {text}"
    user, helper = written("'user'", "''"), written("'assistant'", "''")

    def close(source: str, twice: bool = True) -> str:
        once = f"""select * exclude (s2, s3),
            {best("s2", *(step(f"s{a}", 3, "I", user) for a in (0, 1, 3)))} as s2, {best("s3", step("s2", 3, "I", helper))} as s3 from ({source})"""
        return close(once, False) if twice else once

    more, go = "case when fault = 'truncated' then 3 else 0 end", "fault not in ('blank', 'duplicate')"
    keep = lambda a, c: step(f"s{a}", more, "K", written("role", "text"), f"{go} and c = '{c}'")
    change = lambda a, role: step(f"s{a}", f"3 + {more}", "R", written(f"'{role}'", "text"), go)
    drop = lambda a: step(f"s{a}", 4, "D", "''")
    turn = f"""select w.conv_id, w.i + 1 as i, {drop(0)} as s0, {best(drop(1), keep(0, "s"))} as s1,
        {best(drop(2), *(keep(a, "u") for a in (0, 1, 3)), *(change(a, "user") for a in (0, 1, 3)))} as s2,
        {best(drop(3), keep(2, "a"), change(2, "assistant"))} as s3
        from ways w join faults f on f.conv_id is not distinct from w.conv_id and f.i = w.i + 1"""
    way = "struct(cost int, audit varchar, \"out\" varchar)"
    start = f"select distinct conv_id, 0 as i, {{'cost': 0, 'audit': '', 'out': ''}}::{way} as s0, null::{way} as s1, null::{way} as s2, null::{way} as s3 from conversations"
    columns = "conv_id, i, s0, s1, s2, s3"
    return f"""
        with recursive coded as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
                {crc32_sql("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 as code from conversations),
        damaged as (select conv_id, turn, case when code = 4 then 'user' else role end as role,
                case code when 1 then '' when 2 then translate(text, '.!?', '') else text end as text,
                unnest(case code when 0 then [] when 3 then [1, 2] else [1] end) as copy from coded),
        placed as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i from damaged),
        marked as (select *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as shown, left(role, 1) as c,
                row_number() over (partition by conv_id, role, text order by i) > 1 as seen, lag(left(role, 1)) over (partition by conv_id order by i) as before from placed),
        faults as (select *, case when shown = '' then 'blank' when seen then 'duplicate' when right(shown, 1) in ('.', '!', '?') then '' else 'truncated' end as fault from marked),
        counts as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank,
                count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated,
                count(*) filter (before is not null and before || c not in ('su', 'ua', 'au')) as illegal from faults group by conv_id),
        ways({columns}) as (select {columns} from ({close(start)}) union all select {columns} from ({close(turn)})),
        ends as (select conv_id, {best("s0", "s3")} as w, i from ways qualify i = max(i) over (partition by conv_id))
        select e.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
               coalesce(illegal, 0) as illegal, w.cost::bigint as cost, w.audit as audit, sha256(substr(w.out, 2)) as repaired_sha256
        from ends e left join counts c on c.conv_id is not distinct from e.conv_id
    """


def secret_sql() -> str:
    """The secret scan in SQL: stretches between matches and matches give the spans, as in the operator."""
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    rules = " union all ".join(
        f"select doc_id, {quoted(r.kind)} as kind, {i} as ord, {r.least} as least, string_split_regex(text, {quoted(r.pattern)}) as gaps, "
        f"regexp_extract_all(text, {quoted(r.pattern)}) as whole, regexp_extract_all(text, {quoted(r.pattern)}, {r.group}) as counted "
        f"from texts where regexp_matches(text, {quoted(r.hint)})"
        for i, r in enumerate(secret_scan.RULES)
    )
    base = f"ord < {len(secret_scan.BASE_RULES)}"
    counts = ", ".join(f"count(*) filter (kind = '{r.kind}') as n_{r.kind}" for r in secret_scan.BASE_RULES)
    span = "kind || ':' || begins || ':' || (begins + size)"
    return f"""
        with texts as (select doc_id, coalesce(text, '') as text from documents),
        matches as ({rules}),
        placed as (select doc_id, kind, ord, least, whole, counted, gaps, unnest(range(1, len(whole) + 1)) as i from matches),
        spans as (
            select doc_id, kind, ord, length(whole[i]) as size,
                   cast(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(whole[1:i - 1], lambda x: length(x))), 0) as bigint) as begins
            from placed where length(counted[i]) >= least
        ),
        found as (
            select doc_id, {counts}, string_agg({span}, ',' order by begins, ord) filter ({base}) as base, string_agg({span}, ',' order by begins, ord) as spans
            from spans group by doc_id
        )
        select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
               sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
        from texts left join found using (doc_id)
    """


QUERIES = {
    "op1_packing": op1_packing,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_simhash_dedup": op3_simhash_dedup,
    "op4_license_scan": op4_license_scan,
    "op5_warc": op5_warc,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_secret_scan": op7_secret_scan,
    "op8_toxicity": op8_toxicity,
    "op9_language_id": op9_language_id,
    "op10_embedding_dedup": op10_embedding_dedup,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_pii_scan": op12_pii_scan,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLE_SQL = {
    "op11_merkle_manifest": merkle_sql(),
    "op13_conversation_repair": repair_sql(),
    "op7_secret_scan": secret_sql(),
    "op10_embedding_dedup": """
        with recursive v as (select vec_id, label, embedding::double[] as e from embeddings),
        fine as (select * from v where label is not null and list_dot_product(e, e) > 0 and isfinite(list_dot_product(e, e))),
        links as (select a.vec_id as a, b.vec_id as b from fine a join fine b on a.label = b.label and a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.93),
        reach(id, other) as (select vec_id, vec_id from v union select reach.id, links.b from reach join links on links.a = reach.other),
        least as (select id, min(other) as component_id from reach group by id),
        counts as (select a, count(*) as n from links group by a)
        select vec_id, coalesce(n, 0) as n_links, component_id, vec_id = component_id as kept
        from v join least on id = vec_id left join counts on a = vec_id
    """,
    "op5_warc": """
        with rows as (select page_id, coalesce(html, '') as html from pages),
        firsts as (select *, octet_length(encode(html)) as size, min(page_id) over (partition by html) as first from rows)
        select page_id, size as payload_bytes, sha256(html) as payload_digest,
               case when size >= 100 and page_id <> first then 'revisit' else 'response' end as record_type,
               case when size >= 100 and page_id <> first then first end as refers_to,
               case when size >= 100 and page_id <> first then 1 else cast(greatest(1, ceil(size / 1048576)) as bigint) end as chunks
        from firsts
    """,
    "op6_exact_dedup": """
        select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size,
               doc_id = max(doc_id) over g as kept, sha256(coalesce(text, '')) as text_sha256
        from documents
        window g as (partition by coalesce(text, ''))
    """,
}
