"""The queries op1 to op13: each operator over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, conversations, fingerprints, lm_scoring, near_dedup, packing, quality_rules, secret_scan, sharding, token_files, toxicity, warc, whitening

SEQUENCE = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_bpe() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def word_bpe() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), byte_bpe(), capacity=SEQUENCE)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    placed = sharding.shuffle_to_shards(docs, 8, seed=20, stable=True)
    text = F.coalesce("text", F.lit(""))
    return placed.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = bpe.encode_documents(table(spark, sf_dir, "documents"), word_bpe(), decode=True)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(ids.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    compared = fingerprints.compare_with_edits(table(spark, sf_dir, "documents"))
    edited = F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256")
    return compared.select("doc_id", "n_chars", edited, "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    machine = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(docs, machine)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = quality_rules.fit_quality_rules(docs, table(spark, sf_dir, "labels"))
    judged = quality_rules.judge_quality(docs, rules)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    manifest = token_files.write_token_files(docs, byte_bpe(), sequence_length=SEQUENCE)
    rows = token_files.with_global_starts(token_files.read_token_files(manifest, docs.schema["doc_id"].dataType), manifest)
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_archives(table(spark, sf_dir, "pages"), stable=True)
    captures = warc.assemble(warc.read_records(manifest))
    return warc.captured_pages(captures).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm_scoring.score_documents(table(spark, sf_dir, "documents"), stable=True)
    return scored.select("doc_id", "n_words", F.round("log_score", 6).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten_vectors(table(spark, sf_dir, "embeddings"), stable=True)
    return found.withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)"))


def damaged(turns: DataFrame) -> DataFrame:
    """Faults for op12, by a hash of conversation and turn: of twenty turns one is dropped, one
    emptied, one loses its sentence ends, one comes twice and one gets another role."""
    space = F.lit(" ")
    said = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")))
    fault = F.pmod(F.crc32(said.cast("binary")), F.lit(20))
    text, role = F.coalesce("text", space), F.coalesce("role", space)
    hurt = turns.withColumn("fault", fault).where("fault != 0").select(
        "conv_id",
        "turn",
        F.when(F.col("fault") == 4, "user").otherwise(role).alias("role"),
        F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return hurt.drop("copy")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    repair = conversations.repair_conversations(damaged(turns))
    digests = conversations.conversation_digests(repair.turns)
    own, counts = F.struct("conv_id").alias("own"), ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    every = turns.select("conv_id").distinct().withColumn("own", own)
    for part in (repair.audits, digests):
        every = every.join(part.withColumn("own", own).drop("conv_id"), "own", "left")
    return every.select(
        "conv_id",
        *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(table(spark, sf_dir, "documents"))
    base = secret_scan.KINDS[:3]

    def of(*kinds: str) -> Column:
        return F.filter("secrets", lambda s: s["kind"].isin(*kinds))

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    return found.select(
        "doc_id",
        *(F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in base),
        F.sha2(joined(of(*base)).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("secrets")).alias("spans"),
    )


QUERIES = {
    "op1_packing": op1_packing,
    "op2_sharding": op2_sharding,
    "op3_bpe": op3_bpe,
    "op4_fingerprints": op4_fingerprints,
    "op5_toxicity": op5_toxicity,
    "op6_near_dedup": op6_near_dedup,
    "op7_quality_rules": op7_quality_rules,
    "op8_token_files": op8_token_files,
    "op9_warc": op9_warc,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_whitening": op11_whitening,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_secret_scan": op13_secret_scan,
}

ORACLE_SQL = {
    "op6_near_dedup": """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\r\\x0b\\f]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS h FROM w, LATERAL (SELECT unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.h = y.h AND x.doc_id < y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
d AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id, doc_id AS o FROM documents UNION SELECT r.doc_id, d.b FROM r JOIN d ON d.a = r.o),
g AS (SELECT doc_id, min(o) AS component_id FROM r GROUP BY 1)
SELECT g.doc_id, coalesce(n, 0) AS n_shingles, component_id, g.doc_id = component_id AS kept FROM g LEFT JOIN n ON n.doc_id = g.doc_id""",
    "op9_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
h AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha256(payload) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM h WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id IS DISTINCT FROM first AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM h LEFT JOIN f USING (payload_digest)""",
    "op10_lm_scoring": """
WITH w AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[ \\t\\n\\r\\x0b\\f]+'), lambda x: x <> '') AS ws FROM documents),
u AS (SELECT doc_id, i, ws[i] AS c, CASE WHEN i > 1 THEN ws[i - 1] END AS b, CASE WHEN i > 2 THEN ws[i - 2] END AS a FROM w, LATERAL (SELECT unnest(range(1, len(ws) + 1)) AS i)),
n1 AS (SELECT c, count(*) AS n FROM u GROUP BY ALL), n2 AS (SELECT b, c, count(*) AS n FROM u WHERE i > 1 GROUP BY ALL), n3 AS (SELECT a, b, c, count(*) AS n FROM u WHERE i > 2 GROUP BY ALL),
j AS (SELECT u.doc_id, u.i, n1.n AS c1, x.n AS c2, y.n AS c3, ctx1.n AS d1, ctx2.n AS d2 FROM u JOIN n1 ON n1.c = u.c LEFT JOIN n2 x ON x.b = u.b AND x.c = u.c
  LEFT JOIN n3 y ON y.a = u.a AND y.b = u.b AND y.c = u.c LEFT JOIN n1 ctx1 ON ctx1.c = u.b LEFT JOIN n2 ctx2 ON ctx2.b = u.a AND ctx2.c = u.b),
s AS (SELECT doc_id, CASE WHEN c3 >= 2 THEN ln(c3 / d2) ELSE CASE WHEN i > 2 THEN ln(0.4) ELSE 0 END + CASE WHEN c2 >= 2 THEN ln(c2 / d1)
  ELSE CASE WHEN i > 1 THEN ln(0.4) ELSE 0 END + ln(c1 / (SELECT count(*) FROM u)) END END AS s FROM j),
t AS (SELECT doc_id, sum(s) AS s, count(*) AS n FROM s GROUP BY 1)
SELECT w.doc_id, len(ws) AS n_words, round(coalesce(s, 0), 6) AS log_score, round(s / n, 6) AS mean_log_score FROM w LEFT JOIN t ON t.doc_id = w.doc_id""",
}
