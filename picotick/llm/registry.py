"""Queries of the numbered operators and their DuckDB SQL."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, concatenation, conversation_repair, jaccard_join, merkle_manifest, mixing, packing, quality_classifier, quality_rules, substring_dedup, suffix_dedup, url_filters, vector_dedup

WORD = r"[^\x20\x09-\x0D]+"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.score(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _stop_list() -> str:
    forms = sorted({f for line in quality_rules.STOP_WORDS.values() for w in line.split() for f in (w, w[:1].upper() + w[1:])})
    return ", ".join(f"'{f}'" for f in forms)


OP4_SQL = rf"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), l AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), g AS (
  SELECT doc_id, i, words[i:i+4] AS gram FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)
), d AS (
  SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1
), r AS (
  SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM d) GROUP BY doc_id
), m AS (
  SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
    CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, n_lines,
    len(list_filter(words, lambda x: x IN ({_stop_list()}))) AS n_stop
  FROM w LEFT JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)
), b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars / n_words BETWEEN 1.5 AND 20 AND n_symbols / n_words <= 0.1
    AND (n_words < {quality_rules.SHORT} OR n_stop / n_words >= 0.01) AND coalesce(n_dup_lines / n_lines <= 0.5, true) AS kept
FROM b
"""

URL_RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql(f"SELECT * FROM VALUES {', '.join(str(x) for x in URL_RULES)} AS t(rule, action)")
    return url_filters.judge(_read(spark, sf_dir, "pages"), rules)


OP6_SQL = rf"""
WITH r(rule, action) AS (VALUES {", ".join(str(x) for x in URL_RULES)}), p AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path, row_number() OVER () AS n FROM pages
), f AS (
  SELECT n, rule, action FROM p, r WHERE ('.' || host) LIKE ('%.' || split_part(rule, '/', 1)) AND starts_with(path, substr(rule, strpos(rule, '/')))
  QUALIFY row_number() OVER (PARTITION BY n ORDER BY length(rule) DESC) = 1
)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM p LEFT JOIN f USING (n)
"""

def _chat_digests(batches):
    """Reads each formatted conversation back and digests its turns and the text under its loss mask."""
    for b in batches:
        rows = []
        for c, text, spans in zip(*(b.column(k).to_pylist() for k in ("conv_id", "formatted", "loss")), strict=True):
            turns = chat_format.parse(text)
            said = "".join(f"{role}\n{body}\n" for role, body, _, _ in turns)
            mask = {(x["start"], x["end"]) for x in spans}
            loss = "".join(body for _, body, start, end in turns if (start, end) in mask)
            rows.append((c, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
        if rows:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=list(names))


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    more = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    formatted = chat_format.format_conversations(given.unionByName(more))
    return formatted.mapInArrow(_chat_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


OP1_SQL = r"""
WITH c AS (
  SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, CASE WHEN contains(text, chr(92)) OR contains(text, '</turn>') THEN length(text) + length(text) - length(replace(text, chr(92), ''))
      + (length(text) - length(replace(text, '</turn>', ''))) // 7 ELSE length(text) END
    + length(role) + 14 AS chars FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.dedup(_read(spark, sf_dir, "documents"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return found.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), w AS (
  SELECT doc_id, i, array_to_string(words[i:i+19], ' ') AS win FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM d WHERE len(words) >= 20)
), r AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS n FROM w) WHERE n > 1
), g AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM r
), k AS (
  SELECT doc_id, i, word, g.i IS NOT NULL AS gone FROM (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM d) LEFT JOIN g USING (doc_id, i)
), s AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM k GROUP BY doc_id
)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(kept_sha256, sha256('')) AS kept_sha256 FROM d LEFT JOIN s USING (doc_id)
"""


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.dedup(_read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), w AS (
  SELECT doc_id, i, h[2 * i + 1 : 2 * i + 200] AS s FROM (SELECT doc_id, h, unnest(range(length(h) // 2 - 99)) AS i FROM d WHERE length(h) >= 200)
), r AS (
  SELECT doc_id, i FROM w QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1
), b AS (
  SELECT doc_id, i, h[2 * i + 1 : 2 * i + 2] AS c FROM (SELECT doc_id, h, unnest(range(length(h) // 2)) AS i FROM d)
), g AS (
  SELECT b.doc_id, b.i, c, last_value(r.i IGNORE NULLS) OVER (PARTITION BY b.doc_id ORDER BY b.i) AS latest FROM b LEFT JOIN r USING (doc_id, i)
), k AS (
  SELECT doc_id, i, c, coalesce(i - latest < 100, false) AS gone FROM g
), e AS (
  SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS begins FROM k
), s AS (
  SELECT doc_id, count(*) AS n_bytes, count(*) FILTER (gone) AS n_removed, count(*) FILTER (begins) AS n_spans,
    sha256(unhex(coalesce(string_agg(c, '' ORDER BY i) FILTER (NOT gone), ''))) AS kept_sha256 FROM e GROUP BY doc_id
)
SELECT doc_id, coalesce(n_bytes, 0) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, coalesce(kept_sha256, sha256('')) AS kept_sha256
FROM d LEFT JOIN s USING (doc_id)
"""


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")

    def held(c: str):
        return F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")) % 5 == 0

    weights = quality_classifier.train(docs, labels.where(~held("doc_id")))
    scored = quality_classifier.score(docs, weights)
    return scored.select("doc_id", held("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.dedup(_read(spark, sf_dir, "embeddings"))


OP8_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
), u AS (
  SELECT vec_id, x FROM v WHERE len(x) > 0 AND len(list_filter(x, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND list_dot_product(x, x) > 0
), p AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u AS a JOIN u AS b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.9
), r AS (
  SELECT vec_id, vec_id AS root FROM v UNION SELECT r.vec_id, p.b FROM r JOIN p ON r.root = p.a
), c AS (
  SELECT vec_id, min(root) AS component_id FROM r GROUP BY vec_id
)
SELECT vec_id, (SELECT count(*) FROM p WHERE p.a = c.vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM c
"""


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken")


OP9_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(text, '')), 1, 13) AS BIGINT) AS tie, row_number() OVER () AS n FROM documents
), k AS (
  SELECT *, -ln((CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':{mixing.SEED}'), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE)
    / (0.25::DOUBLE + 0.75::DOUBLE * least(1.0::DOUBLE, size / 200::DOUBLE)) AS key FROM d
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, ([5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM d GROUP BY source
), f AS (
  SELECT *, 3.0::DOUBLE * source_size AS cap,
    (sum(source_size) OVER ()::DOUBLE - coalesce(sum(3.0::DOUBLE * source_size) OVER (ORDER BY 3.0::DOUBLE * source_size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY 3.0::DOUBLE * source_size / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s
), t AS (
  SELECT source, source_size, round(least(cap, coalesce(max(level) FILTER (level <= cap / w) OVER (), 'inf'::DOUBLE) * w), 6) AS target FROM f
), b AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t
), o AS (
  SELECT k.*, b.source_size, b.target, b.epochs, target - epochs * source_size AS budget,
    sum(size) OVER (PARTITION BY k.source ORDER BY key, size, tie, n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM k JOIN b ON k.source IS NOT DISTINCT FROM b.source
), g AS (
  SELECT *, budget - coalesce(max(upto) FILTER (upto <= budget) OVER (PARTITION BY source), 0) AS gap FROM o
), e AS (
  SELECT n FROM g WHERE upto > budget AND size > 0 AND size <= gap QUALIFY row_number() OVER (PARTITION BY source ORDER BY size DESC, key, tie, n) = 1
)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN size = 0 THEN 0 ELSE size * (epochs + CASE WHEN upto <= budget OR n IN (SELECT n FROM e) THEN 1 ELSE 0 END) END AS BIGINT) AS taken
FROM g
"""

def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(_read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


OP10_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i+3], ' ') AS shingle FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 1) + 1)) AS i FROM d WHERE len(words) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), m AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s AS a JOIN s AS b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL
), p AS (
  SELECT a, b FROM m JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
), r AS (
  SELECT doc_id, doc_id AS root FROM d UNION SELECT r.doc_id, p.b FROM r JOIN p ON r.root = p.a
), k AS (
  SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM k LEFT JOIN n USING (doc_id)
"""


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    changed = [F.translate("text", upper, lower) if f == "text" else F.col(f) for f in merkle_manifest.FIELDS]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, merkle_manifest.digest(merkle_manifest.preimage(*changed)))
    found = merkle_manifest.manifest(_read(spark, sf_dir, "documents"), keep={"tampered": tampered})
    folded = found.withColumn("folded_root", merkle_manifest.fold(F.coalesce("tampered", "leaf"), F.col("proof")))
    proof = merkle_manifest.digest(merkle_manifest.siblings_of(F.col("proof")))
    return folded.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: CRC-32 of an ASCII text in SQL: the table of the bytes, then a fold over the characters.
_CRC_TABLE = "SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, i: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)) ORDER BY b) AS tbl FROM (SELECT unnest(range(256)) AS b)"


def _crc(text: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split({text}, ''), lambda s: CAST(ord(s) AS BIGINT))), lambda c, b: xor(c >> 8, tbl[(xor(c, b) & 255) + 1])), 4294967295)"


def _field(name: str) -> str:
    return f"coalesce(strlen(CAST({name} AS VARCHAR)) || ':' || CAST({name} AS VARCHAR), '-')"


OP11_SQL = f"""
WITH RECURSIVE crc AS ({_CRC_TABLE}), d AS (
  SELECT doc_id, source, row_number() OVER () AS n, sha256({" || ".join(map(_field, merkle_manifest.FIELDS))}) AS leaf,
    CASE WHEN {_crc("CAST(doc_id AS VARCHAR)")} % 5 = 0 THEN sha256({" || ".join(_field(f) if f != "text" else _field("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')") for f in merkle_manifest.FIELDS)}) END AS tampered
  FROM documents, crc
), p AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS members FROM d
), t AS (
  SELECT coalesce(':' || source, '') AS grp, 0 AS k, pos, members, leaf AS h FROM p
  UNION ALL SELECT grp, k + 1, pos // 16, any_value(members + 15) // 16, sha256(string_agg(h, '' ORDER BY pos)) FROM t WHERE members > 1 GROUP BY grp, k, pos // 16
), s AS (
  SELECT grp, h AS subroot, row_number() OVER (ORDER BY encode(grp)) - 1 AS pos, count(*) OVER () AS members FROM t WHERE members = 1
), u AS (
  SELECT 0 AS k, pos, members, subroot AS h FROM s
  UNION ALL SELECT k + 1, pos // 16, any_value(members + 15) // 16, sha256(string_agg(h, '' ORDER BY pos)) FROM u WHERE members > 1 GROUP BY k, pos // 16
), a AS (
  SELECT p.n, t.k AS step, string_agg(t.h, '' ORDER BY t.pos) FILTER (t.pos < p.pos // (16 ** t.k)::BIGINT) AS before, string_agg(t.h, '' ORDER BY t.pos) FILTER (t.pos > p.pos // (16 ** t.k)::BIGINT) AS after
  FROM p JOIN t ON t.grp = coalesce(':' || p.source, '') AND t.members > 1 AND t.pos // 16 = p.pos // (16 ** (t.k + 1))::BIGINT GROUP BY p.n, t.k
  UNION ALL SELECT p.n, 100 + u.k, string_agg(u.h, '' ORDER BY u.pos) FILTER (u.pos < s.pos // (16 ** u.k)::BIGINT), string_agg(u.h, '' ORDER BY u.pos) FILTER (u.pos > s.pos // (16 ** u.k)::BIGINT)
  FROM p JOIN s ON s.grp = coalesce(':' || p.source, '') JOIN u ON u.members > 1 AND u.pos // 16 = s.pos // (16 ** (u.k + 1))::BIGINT GROUP BY p.n, u.k
), o AS (
  SELECT n, row_number() OVER (PARTITION BY n ORDER BY step) AS j, coalesce(before, '') AS before, coalesce(after, '') AS after FROM a
), f AS (
  SELECT n, CAST(0 AS BIGINT) AS j, coalesce(tampered, leaf) AS h FROM p UNION ALL SELECT f.n, o.j, sha256(o.before || f.h || o.after) FROM f JOIN o ON o.n = f.n AND o.j = f.j + 1
), e AS (
  SELECT n, arg_max(h, j) AS folded_root FROM f GROUP BY n
), q AS (
  SELECT n, sha256(string_agg(before || after, '' ORDER BY j)) AS proof_sha256 FROM o GROUP BY n
), r AS (
  SELECT h AS root FROM u WHERE members = 1
)
SELECT doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM p JOIN s ON s.grp = coalesce(':' || source, '') JOIN e USING (n) LEFT JOIN q USING (n), r
"""


def _repair_digests(batches):
    """The rows of ``repair`` in their order -> each conversation's counts and the hash of its turns, a piece at a time."""
    names = ("conv_id", *conversation_repair.STATS, "audit", "repaired_sha256")
    kinds = [*[pa.int64()] * (len(names) - 2), pa.string(), pa.string()]
    conv, found, digest, first = None, None, None, True

    def row():
        return (conv, *(found[c] for c in (*conversation_repair.STATS, "audit")), digest.hexdigest())

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=list(names))

    for b in batches:
        done = []
        for c, head, role, text in zip(*(b.column(k).to_pylist() for k in ("conv_id", "found", "role", "text")), strict=True):
            if head is not None:
                if found:
                    done.append(row())
                conv, found, digest, first = c, head, hashlib.sha256(), True
                continue
            digest.update(f"{'' if first else chr(10)}{role}:{text}".encode())
            first = False
        if done:
            yield batch(done)
    if found:
        yield batch([row()])


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = conversation_repair.damage(_read(spark, sf_dir, "conversations"))
    turns = conversation_repair.repair(damaged, present=F.col("present"))
    counts = ", ".join(f"{c} long" for c in conversation_repair.STATS)
    return turns.mapInArrow(_repair_digests, f"conv_id long, {counts}, audit string, repaired_sha256 string")


OP12_SQL = rf"""
WITH RECURSIVE crc AS ({_CRC_TABLE}), g AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {_crc("(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS draw FROM conversations, crc
), d AS (
  SELECT conv_id, turn, CASE WHEN draw = 4 THEN 'user' ELSE role END AS role, CASE draw WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE WHEN draw = 3 THEN 2 ELSE 1 END)) FROM g WHERE draw <> 0)
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, encode(role), md5(text)) AS i, count(*) OVER (PARTITION BY conv_id) AS n,
    left(role, 1) AS r FROM d
), l AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'b' WHEN i > min(i) OVER (PARTITION BY conv_id, role, text) THEN 'd' WHEN NOT regexp_matches(text, '[.!?][ 	-
]*\z') THEN 't' ELSE '' END AS fault,
    r || lead(r) OVER (PARTITION BY conv_id ORDER BY i) AS pair FROM o
), f AS (
  SELECT conv_id, n + 1 AS i, {{'c': 0, 'a': ''}} AS f0, {{'c': 4, 'a': 'II'}} AS f1, {{'c': 2, 'a': 'I'}} AS f2, {{'c': 0, 'a': ''}} AS f3 FROM (SELECT DISTINCT conv_id, n FROM l)
  UNION ALL SELECT conv_id, i, least(g0, {{'c': g2.c + 2, 'a': 'I' || g2.a}}, {{'c': g3.c + 4, 'a': 'II' || g3.a}}), least(g1, {{'c': g2.c + 2, 'a': 'I' || g2.a}}, {{'c': g3.c + 4, 'a': 'II' || g3.a}}),
    least(g2, {{'c': g3.c + 2, 'a': 'I' || g3.a}}), least(g3, {{'c': g2.c + 2, 'a': 'I' || g2.a}})
  FROM (SELECT l.conv_id, l.i,
    least({{'c': f0.c + 3, 'a': 'D' || f0.a}}, {{'c': CASE WHEN r = 's' THEN f1.c + y WHEN r = 'u' THEN f2.c + y ELSE 999999 END, 'a': 'K' || CASE WHEN r = 's' THEN f1.a ELSE f2.a END}}, {{'c': f2.c + y + 2, 'a': 'R' || f2.a}}) AS g0,
    least({{'c': f1.c + 3, 'a': 'D' || f1.a}}, {{'c': CASE WHEN r = 'u' THEN f2.c + y ELSE 999999 END, 'a': 'K' || f2.a}}, {{'c': f2.c + y + 2, 'a': 'R' || f2.a}}) AS g1,
    least({{'c': f2.c + 3, 'a': 'D' || f2.a}}, {{'c': CASE WHEN r = 'a' THEN f3.c + y ELSE 999999 END, 'a': 'K' || f3.a}}, {{'c': f3.c + y + 2, 'a': 'R' || f3.a}}) AS g2,
    least({{'c': f3.c + 3, 'a': 'D' || f3.a}}, {{'c': CASE WHEN r = 'u' THEN f2.c + y ELSE 999999 END, 'a': 'K' || f2.a}}, {{'c': f2.c + y + 2, 'a': 'R' || f2.a}}) AS g3
    FROM (SELECT *, CASE fault WHEN 'b' THEN 999999 WHEN 'd' THEN 999999 WHEN 't' THEN 1 ELSE 0 END AS y FROM l) AS l JOIN f ON l.conv_id IS NOT DISTINCT FROM f.conv_id AND l.i = f.i - 1)
), a AS (
  SELECT conv_id, f0.c AS cost, f0.a AS audit FROM f WHERE i = 1
), e AS (
  SELECT conv_id, j, audit[j] AS edit, count(*) FILTER (audit[j] <> 'I') OVER w AS i, count(*) FILTER (audit[j] <> 'D') OVER w AS place
  FROM (SELECT *, unnest(range(1, length(audit) + 1)) AS j FROM a) WINDOW w AS (PARTITION BY conv_id ORDER BY j)
), m AS (
  SELECT e.conv_id, e.place, e.edit, l.role, CASE WHEN e.edit = 'I' THEN '' ELSE l.text END AS text, count(*) OVER (PARTITION BY e.conv_id) % 2 AS odd
  FROM e LEFT JOIN l ON e.conv_id IS NOT DISTINCT FROM l.conv_id AND e.i = l.i AND e.edit <> 'I' WHERE e.edit <> 'D'
), h AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (place + odd) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY place)) AS repaired_sha256 FROM m GROUP BY conv_id
), c AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
    count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM l GROUP BY conv_id
)
SELECT z.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS z LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM z.conv_id LEFT JOIN a ON a.conv_id IS NOT DISTINCT FROM z.conv_id LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM z.conv_id
"""


def op13_concatenation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = concatenation.pack(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


#: name -> (query, DuckDB SQL or None)
QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "op1_chat_format": (op1_chat_format, OP1_SQL),
    "op2_substring_dedup": (op2_substring_dedup, OP2_SQL),
    "op3_packing": (op3_packing, None),
    "op4_quality_rules": (op4_quality_rules, OP4_SQL),
    "op5_suffix_dedup": (op5_suffix_dedup, OP5_SQL),
    "op6_url_filters": (op6_url_filters, OP6_SQL),
    "op7_quality_classifier": (op7_quality_classifier, None),
    "op8_vector_dedup": (op8_vector_dedup, OP8_SQL),
    "op9_mixing": (op9_mixing, OP9_SQL),
    "op10_jaccard_join": (op10_jaccard_join, OP10_SQL),
    "op11_merkle_manifest": (op11_merkle_manifest, OP11_SQL),
    "op12_conversation_repair": (op12_conversation_repair, OP12_SQL),
    "op13_concatenation": (op13_concatenation, None),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
