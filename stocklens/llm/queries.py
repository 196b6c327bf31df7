"""The registered queries of this subpackage, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stocklens.llm import (
    bagminhash,
    bpe,
    conversations,
    decision_list,
    mixing,
    nn_descent,
    quality_net,
    secrets,
    segment_filter,
    stable_projections,
    token_counts,
    toxicity,
    warc,
)
from stocklens.llm.labelled import remainder

MULTI_VOCABULARY = "byte_bpe_multi_50k.tiktoken"
MERGE_VOCABULARY = "byte_bpe_50k.json"
TOKEN_LIMIT = 512
QUALITY_LEAST, TOXIC_LEAST = 0.5, 0.3
BASE_KINDS = ("assign", "access", "hex")
#: Wanted shares of tokens by language.
MIX = {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path(MULTI_VOCABULARY)
    back = bpe.decode(bpe.encode(table(spark, folder, "documents"), path), path)
    return back.select(
        "doc_id",
        "n_tokens",
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, folder, "documents"))
    return found.select(
        "doc_id",
        *[secrets.count_of("spans", kind).alias(f"n_{kind}") for kind in BASE_KINDS],
        F.sha2(secrets.kinds_of("spans", BASE_KINDS), 256).alias("base_sha256"),
        secrets.kinds_of("spans", [rule.kind for rule in secrets.RULES]).alias("spans"),
    )


def quality_score(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    network = quality_net.fit(docs, table(spark, folder, "labels"))
    return _judged(quality_net.scored(docs, network), 3, 1, QUALITY_LEAST)


def toxic_score(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = toxicity.fit(docs, table(spark, folder, "labels"))
    return _judged(toxicity.scored(docs, model), 4, 2, TOXIC_LEAST)


def _judged(scored: DataFrame, divisor: int, left_out: int, least: float) -> DataFrame:
    return scored.select(
        "doc_id",
        F.coalesce(remainder("doc_id", divisor) == left_out, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= least).cast("int").alias("predicted"),
    )


def warc_archives(spark: SparkSession, folder: str) -> DataFrame:
    read = warc.archived(table(spark, folder, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    rules = decision_list.fit(docs, table(spark, folder, "labels"))
    return decision_list.judged(docs, rules).select("doc_id", *decision_list.COUNTS, "base_failed", "kept")


def token_count(spark: SparkSession, folder: str) -> DataFrame:
    counted = token_counts.count_tokens(
        table(spark, folder, "documents"), public_tokenizers.path(MERGE_VOCABULARY)
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return nn_descent.linked(table(spark, folder, "embeddings"))


def minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return bagminhash.near_duplicates(table(spark, folder, "documents"))


def domains_of_labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The labelled table of the mix: the language of the documents that ``labels`` covers."""
    known = labels.select("doc_id").filter("doc_id is not null").distinct()
    return docs.join(known, "doc_id", "left_semi").select("doc_id", F.col("lang").alias("domain"))


def mixing_rates(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    labelled = domains_of_labelled(docs, table(spark, folder, "labels"))
    found, model = mixing.rated(docs, labelled, MIX)
    shares = [F.col(f"p{k}").alias(f"p_{name}") for k, name in enumerate(model.domains)]
    return found.select("doc_id", "n_tokens", "domain", "rate", "copies", *shares)


def nearest_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return stable_projections.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


def hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    # floor() gives 64 bits, and larger doubles are whole anyway
    floor = lambda x: F.when(F.abs(x) < float(1 << 53), F.floor(x).cast("double")).otherwise(x)
    whole = F.transform(F.col("embedding").cast("array<double>"), lambda x: floor(x * 256))
    rows = table(spark, folder, "embeddings").select("vec_id", moved.alias("label"), whole.alias("vector"))
    return segment_filter.hard_negatives(rows, F.col("vec_id") % 100 == 0)


def conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.audited(table(spark, folder, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_byte_bpe": byte_bpe,
        "op2_secret_scan": secret_scan,
        "op3_quality_net": quality_score,
        "op4_warc": warc_archives,
        "op5_quality_rules": quality_rules,
        "op6_token_counts": token_count,
        "op7_embedding_near_dedup": embedding_near_dedup,
        "op8_toxicity": toxic_score,
        "op9_minhash_near_dedup": minhash_near_dedup,
        "op10_mixing": mixing_rates,
        "op11_nearest_vectors": nearest_vectors,
        "op12_hard_negatives": hard_negatives,
        "op13_conversation_repair": conversation_repair,
    }


#: Of records with equal payloads of 1000 bytes or more the largest page is the response.
_WARC = """
WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS payload FROM pages
), digests AS (
  SELECT page_id, strlen(payload) AS payload_bytes, sha1(payload) AS payload_digest,
         CASE WHEN strlen(payload) >= 1000 THEN max(page_id) OVER (PARTITION BY payload) ELSE page_id END AS first_id
  FROM payloads
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first_id = page_id THEN NULL ELSE first_id END AS refers_to
FROM digests
"""

#: All pairs by cosine, then the smallest id reachable.
_EMBEDDINGS = """
WITH RECURSIVE vectors AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), near AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM vectors a JOIN vectors b
    ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.95
), reach(vec_id, other) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT reach.vec_id, near.b FROM reach JOIN near ON near.a = reach.other
), component AS (
  SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id
)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, c.component_id = e.vec_id AS kept
FROM (SELECT DISTINCT vec_id FROM embeddings) e JOIN component c USING (vec_id)
LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM near GROUP BY a) n USING (vec_id)
"""

#: All pairs of texts that share a run of five words, compared as multisets of such runs.
_NEAR_DUPLICATES = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), runs AS (
  SELECT doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS run
  FROM words WHERE len(w) > 0
), counted AS (
  SELECT doc_id, run, count(*) AS n FROM runs GROUP BY doc_id, run
), sizes AS (
  SELECT doc_id, sum(n) AS size FROM counted GROUP BY doc_id
), common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, sum(least(x.n, y.n)) AS shared
  FROM counted x JOIN counted y ON x.run = y.run AND x.doc_id <> y.doc_id
  GROUP BY x.doc_id, y.doc_id
), near AS (
  SELECT a, b FROM common JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b
  WHERE CAST(shared AS DOUBLE) / (s.size + t.size - shared) >= 0.8
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT reach.doc_id, near.b FROM reach JOIN near ON near.a = reach.other
)
SELECT doc_id, min(other) AS class_id, min(other) = doc_id AS kept FROM reach GROUP BY doc_id
"""


#: Every row against every anchor.
_HARD_NEGATIVES = """
WITH vectors AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, x.vec_id, a.label = x.label AS alike,
         CAST(list_sum(list_transform(list_zip(a.v, x.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM vectors a JOIN vectors x ON a.vec_id <> x.vec_id AND len(a.v) = len(x.v)
  WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score,
         row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place
  FROM scored WHERE alike
), inside AS (
  SELECT p.anchor_id, p.positive_id, p.positive_score, n.vec_id AS negative_id, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id) AS rank
  FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.alike
    AND 80 * p.positive_score <= 100 * n.score AND n.score <= p.positive_score
  WHERE p.place <= 5
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM inside WHERE rank <= 5
"""

#: The damage by a checksum written out, then all cheapest ways row by row.
_CONVERSATIONS = r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), '') AS letters
  FROM conversations
), chances AS (
  SELECT conv_id, turn, role, text, xor(list_reduce(list_transform(letters, lambda c: CAST(ord(c) AS BIGINT)), lambda crc, byte:
    list_reduce(range(0, 8), lambda r, i: xor(r >> 1, 3988292384 * (r & 1)), xor(crc, byte)), 4294967295), 4294967295) % 20 AS chance
  FROM keyed
), hurt AS (
  SELECT conv_id, turn, CASE WHEN chance = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN chance = 1 THEN '' WHEN chance = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN chance = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM chances WHERE chance <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS place FROM hurt
), judged AS (
  SELECT *, left(role, 1) AS initial, regexp_replace(text, '[ 	-
]+$', '') AS ink,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 AS again,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY place) || left(role, 1) AS pair
  FROM placed
), faults AS (
  SELECT *, ink = '' AS blank, ink <> '' AND again AS duplicate,
         ink <> '' AND NOT again AND NOT regexp_matches(ink, '[.!?]$') AS truncated
  FROM judged
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         sum(CAST(blank AS INTEGER)) AS blank, sum(CAST(duplicate AS INTEGER)) AS duplicate,
         sum(CAST(truncated AS INTEGER)) AS truncated,
         sum(CAST(pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au') AS INTEGER)) AS illegal
  FROM faults GROUP BY conv_id
), inserted(state, reached, letters, lines, spent) AS (
  VALUES ('0', '0', '', '', 0), ('0', 'u', 'I', 'user:|', 5), ('0', 'a', 'II', 'user:|assistant:|', 10),
         ('s', 's', '', '', 0), ('s', 'u', 'I', 'user:|', 5), ('s', 'a', 'II', 'user:|assistant:|', 10),
         ('u', 'u', '', '', 0), ('u', 'a', 'I', 'assistant:|', 5), ('a', 'a', '', '', 0), ('a', 'u', 'I', 'user:|', 5)
), allowed(reached, initial, after) AS (
  VALUES ('0', 's', 's'), ('0', 'u', 'u'), ('s', 'u', 'u'), ('u', 'a', 'a'), ('a', 'u', 'u')
), edits(letter, price) AS (
  VALUES ('D', 2), ('K', 0), ('R', 1)
), ways(conv_id, place, state, cost, audit, fixed) AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT), '0', 0, '', '' FROM conversations
  UNION ALL
  SELECT conv_id, place, state, best.cost, best.audit, best.fixed FROM (
    SELECT w.conv_id, w.place + 1 AS place,
           CASE e.letter WHEN 'D' THEN i.reached WHEN 'K' THEN k.after WHEN 'R' THEN r.after END AS state,
           min({'cost': w.cost + i.spent + e.price + CASE WHEN e.letter <> 'D' AND f.truncated THEN 5 ELSE 0 END,
                'audit': w.audit || i.letters || e.letter,
                'fixed': w.fixed || replace(i.lines, '|', chr(10)) || CASE e.letter WHEN 'D' THEN '' WHEN 'K' THEN f.role || ':' || f.text || chr(10)
                         ELSE CASE r.after WHEN 'u' THEN 'user:' ELSE 'assistant:' END || f.text || chr(10) END}) AS best
    FROM ways w JOIN faults f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.place = w.place + 1
    JOIN inserted i ON i.state = w.state
    JOIN edits e ON e.letter = 'D' OR NOT (f.blank OR f.duplicate)
    LEFT JOIN allowed k ON k.reached = i.reached AND k.initial = f.initial
    LEFT JOIN allowed r ON r.reached = i.reached AND r.initial <> 's'
    WHERE e.letter <> 'K' OR k.after IS NOT NULL
    GROUP BY ALL
  ) steps
), ends AS (
  SELECT w.conv_id, min({'cost': w.cost + i.spent, 'audit': w.audit || i.letters,
                         'fixed': w.fixed || replace(i.lines, '|', chr(10))}) AS best
  FROM ways w JOIN (SELECT conv_id, max(place) AS place FROM ways GROUP BY conv_id) l
    ON l.conv_id IS NOT DISTINCT FROM w.conv_id AND l.place = w.place
  JOIN inserted i ON i.state = w.state AND i.reached IN ('0', 'a')
  GROUP BY w.conv_id
)
SELECT e.conv_id, coalesce(c.gaps, 0) AS gaps, CAST(coalesce(c.blank, 0) AS BIGINT) AS blank,
       CAST(coalesce(c.duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(c.truncated, 0) AS BIGINT) AS truncated,
       CAST(coalesce(c.illegal, 0) AS BIGINT) AS illegal, CAST(e.best.cost AS BIGINT) AS cost, e.best.audit AS audit,
       sha256(regexp_replace(e.best.fixed, '
\z', '')) AS repaired_sha256
FROM ends e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""


def statements() -> dict[str, str]:
    return {
        "op4_warc": _WARC,
        "op7_embedding_near_dedup": _EMBEDDINGS,
        "op9_minhash_near_dedup": _NEAR_DUPLICATES,
        "op12_hard_negatives": _HARD_NEGATIVES,
        "op13_conversation_repair": _CONVERSATIONS,
    }
