"""Queries of this package over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, chat, cohorts, fingerprint, licenses, mixing, negatives, sharding, topk, toxicity, urls
from tessera.llm.common import table
from tessera.llm.similarity import link_counts, ngram_components
from tessera.llm.supermin import near_groups

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_components(table(spark, sf_dir, "documents"), k=4, num=85, den=100)
    return found.select("doc_id", "n_shingles", "component_id")


def op1_ngram_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_counts(table(spark, sf_dir, "documents"), k=4, num=85, den=100)


OP1_SQL = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')))
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM words
), flat AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c
  FROM flat a JOIN flat b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM common WHERE 100 * c >= 85 * (na + nb - c)
), both_ways AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links
), reach(a, b) AS (
  SELECT a, b FROM both_ways UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(min(r.b), s.doc_id)) AS component_id
FROM sets s LEFT JOIN reach r ON r.a = s.doc_id GROUP BY s.doc_id, s.s
"""

def multilingual_vocabulary() -> tuple[str, str]:
    """Path of the vocabulary and its piece pattern; a parameter of the operators, never copied here."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = multilingual_vocabulary()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip_digests(docs, path=path, pattern=pattern).select("doc_id", "bpe.n_tokens", "bpe.ids_sha256", "bpe.decoded_sha256")


def held_out(column: str = "doc_id") -> Column:
    """Rows whose labels are never learned from: CRC-32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 3 == 1, F.lit(False))


#: Scores from here on count as toxic.
TOXIC = 0.7


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels").filter(~held_out()))
    found = toxicity.score(docs, model, out_col="score")
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))


def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprint.edited_fingerprints(table(spark, sf_dir, "documents"))
    found = found.withColumnsRenamed({"fingerprint": "_own", "edited_fingerprint": "_edited"})
    own, edited = F.col("_own"), F.col("_edited")
    return found.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint.as_hex(own).alias("fingerprint"),
        fingerprint.as_hex(edited).alias("edited_fingerprint"),
        fingerprint.likeness(own, edited).alias("near_edited"),
        fingerprint.likeness(own, F.col("next_fingerprint")).alias("near_next"),
    )


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0), k=5, scale=256)


OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scores
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "source", "copies")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), shards=16)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "score")


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.sql(
        "SELECT -7L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)"
    )
    rows = rows.unionByName(own).withColumn("parts", chat.text_part(F.coalesce("text", F.lit(""))))
    return chat.digests(chat.formatted(rows))


OP10_SQL = r"""
WITH every AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, 16 + len(role) + len(text)
    + len(role) - len(replace(replace(replace(role, '\', ''), '<', ''), '[', ''))
    + len(text) - len(replace(replace(replace(text, '\', ''), '<', ''), '[', '')) AS chars FROM every
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(len(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""

def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op11_near_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_groups(table(spark, sf_dir, "documents"), k=3, num=85, den=100)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


#: As for the n-gram join, with shingles of three words and a mark for the component's least document.
OP11_SQL = "SELECT *, doc_id = component_id AS kept FROM (" + OP1_SQL.replace(">= 4", ">= 3").replace("len(w) - 2", "len(w) - 1").replace("w[i:i+3]", "w[i:i+2]") + ")"


def op12_cohort_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks = table(spark, sf_dir, "clicks")
    found = cohorts.retention(clicks, table(spark, sf_dir, "clients"), as_of="2024-03-01 00:00:00", arrives=cohorts.late_arrival(clicks))
    return found.select("state", "segment", "cohort", "period", "users", "users_crc32", "moved", "cents")


def _crc32_sql(value: str) -> str:
    """CRC-32 of a number's decimal digits; ``t`` is the list of the 256 bytes' remainders."""
    codes = f"list_transform(string_split(CAST({value} AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295)"


OP12_SQL = f"""
WITH bytes AS (
  SELECT list(list_reduce(list_prepend(CAST(i AS BIGINT), range(8)), lambda c, k: xor(c >> 1, 3988292384 * (c & 1))) ORDER BY i) AS t FROM range(256) r(i)
), known AS (
  SELECT DISTINCT * FROM clicks WHERE ts IS NOT NULL AND client_id IS NOT NULL
), hashed AS (
  SELECT *, {_crc32_sql("click_id")} AS h FROM known, bytes
), arrived AS (
  SELECT client_id, kind, epoch_us(ts) AS us, coalesce(CAST(floor(100 * value + 0.5) AS BIGINT), 0) AS cents,
    arrived_at + CASE WHEN h % 3 = 0 THEN h % 100 ELSE 0 END * INTERVAL 1 DAY < TIMESTAMP '2024-03-01 00:00:00' AS early FROM hashed
), states AS (
  SELECT 0 AS state, * FROM arrived WHERE early UNION ALL SELECT 1, * FROM arrived
), starts AS (
  SELECT state, client_id, min(us) AS start FROM states WHERE kind = 'purchase' GROUP BY 1, 2
), cohorts AS (
  SELECT *, start // (3 * 86400000000) AS cohort FROM starts
), named AS (
  SELECT s.*, coalesce(c.city, '') AS segment, coalesce(s.cohort <> o.cohort, false) AS moved
  FROM cohorts s LEFT JOIN cohorts o ON o.client_id = s.client_id AND o.state <> s.state LEFT JOIN clients c ON c.client_id = s.client_id
), users AS (
  SELECT state, client_id, segment, cohort, moved, (us - start) // (3 * 86400000000) AS period, sum(cents) AS cents
  FROM states JOIN named USING (state, client_id) WHERE us >= start GROUP BY ALL
)
SELECT state, segment, cohort, period, count(*) AS users, CAST(sum({_crc32_sql("client_id")}) AS BIGINT) AS users_crc32,
  CAST(sum(CAST(moved AS INTEGER)) AS BIGINT) AS moved, CAST(sum(cents) AS BIGINT) AS cents
FROM users, bytes GROUP BY state, segment, cohort, period
"""


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(vectors, F.col("vec_id") % 50 == 0, label=label, positives=5, negatives=3, low=(50, 100), high=(95, 100), scale=256)


OP13_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
    CAST(list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 50 = 0
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) QUALIFY rank <= 3
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op1_ngram_links": op1_ngram_links,
    "op2_bpe_round_trip": op2_bpe_round_trip,
    "op3_toxicity": op3_toxicity,
    "op4_fingerprint": op4_fingerprint,
    "op5_exact_top_k": op5_exact_top_k,
    "op6_mixing": op6_mixing,
    "op7_sharding": op7_sharding,
    "op8_license_scan": op8_license_scan,
    "op9_url_filter": op9_url_filter,
    "op10_chat_format": op10_chat_format,
    "op11_near_groups": op11_near_groups,
    "op12_cohort_retention": op12_cohort_retention,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLES: dict[str, str] = {
    "op1_ngram_jaccard": OP1_SQL,
    "op5_exact_top_k": OP5_SQL,
    "op10_chat_format": OP10_SQL.replace("\\\\", "\\"),
    "op11_near_groups": OP11_SQL,
    "op12_cohort_retention": OP12_SQL,
    "op13_hard_negatives": OP13_SQL,
}
