"""The registered queries of the training-data operators, with production
parameters over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.llm import divergence, exact_dedup, language_id, lm_scoring, mixing, ngram_join, packing, pii, sharding, token_counts, topk, vector_codes, warc
from shelfline.llm.common import shared_dir, stored

#: Shards that op10 places documents on.
SHARDS = [f"shard-{k:03d}" for k in range(64)]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups of all documents that links of four-word shingles, at a
    similarity of 0.85, form."""
    return ngram_join.join_groups(_table(spark, sf_dir, "documents"), ngram_join.Rule(4, 85, 100))


#: Links of all pairs that share a shingle, and what can be reached by them.
OP1_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM words
), sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id
), shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (SELECT x, y FROM shared JOIN sizes s ON s.doc_id = x JOIN sizes t ON t.doc_id = y WHERE 100 * c >= 85 * (s.n + t.n - c)
), ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reached AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, w.y FROM reached r JOIN ways w ON r.other = w.x)
SELECT r.doc_id, coalesce(max(n), 0) AS n_shingles, min(other) AS component_id FROM reached r LEFT JOIN sizes s ON s.doc_id = r.doc_id GROUP BY r.doc_id
"""


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact dedup of all documents against a new, empty index."""
    out = exact_dedup.DigestIndex(spark).add(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", F.col("group_size").cast("bigint").alias("group_size"), "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP2_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""


def tokenizer(name: str) -> str:
    """The path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by the class model of six folds of seven."""
    docs = _table(spark, sf_dir, "documents")
    held_out = language_id.in_fold(F.col("doc_id"), 7, 2)
    return lm_scoring.train_and_score(docs, held_out).withColumnRenamed("extra", "held_out")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from four folds of five."""
    docs = _table(spark, sf_dir, "documents")
    held_out = language_id.in_fold(F.col("doc_id"), 5, 0)
    out = language_id.identify(docs, language_id.learn(docs.where(~held_out)))
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flattest mix of all documents' sources that reads every document
    and none more often than 1.5 epochs of its source."""
    uses = mixing.mix(_table(spark, sf_dir, "documents"), max_epochs=1.5)
    return uses.withColumn("mix_key", F.round("mix_key", 9)).withColumn("weight", F.round("weight", 9))


def op7_warc_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC archives, read back and assembled."""
    path = shared_dir(spark, "archives")
    warc.write_captures(_table(spark, sf_dir, "pages"), path)
    number = F.regexp_extract(F.get("metadata", F.lit(0))["payload"].cast("string"), r"page-id: (-?\d+)", 1).try_cast("bigint")
    read = stored(
        warc.captures(spark, path).select(
            "record_id", number.alias("page_id"), F.col("response.payload_bytes"), F.col("response.payload_digest"),
            F.col("response.warc_type").alias("record_type"), F.col("response.refers_to").alias("target"),
        ),
        "captures",
    )
    targets = read.where("record_type = 'response'").select(F.col("record_id").alias("target"), F.col("page_id").alias("refers_to")).distinct()
    return read.join(targets, "target", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages), d AS (
  SELECT page_id, octet_length(body) AS n, max(page_id) OVER (PARTITION BY body) AS response, sha1(body) AS h FROM p)
SELECT page_id, n::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 1 + 5 * (k // 4), 5))::BIGINT >> (15 - 5 * (k % 4))) & 31), 1)), '') AS payload_digest,
  CASE WHEN response = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN response <> page_id THEN response END AS refers_to
FROM d
"""


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best other vectors of every vector whose id divides by 20."""
    return topk.top_k(_table(spark, sf_dir, "embeddings"), 20, lambda vec_id: vec_id % 20 == 0)


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 20
"""


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of every document, and whether there are over 512."""
    out = token_counts.count_tokens(_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))
    return out.withColumn("over_limit", F.col("n_tokens") > 512)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slot and the shard, of 64, of every document."""
    return sharding.place(_table(spark, sf_dir, "documents").select("doc_id"), "doc_id", SHARDS)


def _op10_sql() -> str:
    """The slot of each id's MD5, and the table of slots as one list."""
    table = ",".join(map(str, sharding.lookup_table(SHARDS).tolist()))
    slot = f"CAST(('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {sharding.TABLE_SIZE} AS INTEGER)"
    return f"SELECT doc_id, slot, t.shards[slot + 1]::INTEGER AS shard FROM (SELECT doc_id, {slot} AS slot FROM documents), (SELECT [{table}] AS shards) t"


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code of every vector, by 16 codebooks of 64 entries."""
    return vector_codes.compress(_table(spark, sf_dir, "embeddings"))


def _op11_sql() -> str:
    """Every part against every entry; two rounds move the entries."""
    assigned = """
n{r} AS (
  SELECT x.vec_id, x.part, x.v, min(struct_pack(d := list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), e := b.entry)) AS best
  FROM parts x JOIN b{r} b ON b.part = x.part GROUP BY x.vec_id, x.part, x.v
)"""
    moved = """
b{s} AS (
  SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM b{r} b LEFT JOIN (
    SELECT part, e AS entry, list(c ORDER BY k) AS v FROM (
      SELECT part, best.e AS e, k, CAST(floor(sum(v[k])::DOUBLE / count(*)) AS BIGINT) AS c FROM n{r}, (SELECT unnest(range(1, (SELECT max(len(v)) FROM parts) + 1)) AS k) GROUP BY ALL
    ) GROUP BY ALL
  ) m ON m.part = b.part AND m.entry = b.entry
)"""
    rounds = ",".join(assigned.format(r=r) + "," + moved.format(r=r, s=r + 1) for r in range(2))
    return f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS (
  SELECT vec_id, part, v[part * (len(v) // 16) + 1:(part + 1) * (len(v) // 16)] AS v FROM kept, (SELECT unnest(range(0, 16)) AS part)
), b0 AS (
  SELECT p.part, f.entry, p.v FROM parts p JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT 64) f ON f.vec_id = p.vec_id
),{rounds},{assigned.format(r=2)}, coded AS (
  SELECT vec_id, string_agg(printf('%02x', best.e), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM n2 GROUP BY vec_id
), books AS (
  SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS h FROM b2
)
SELECT c.vec_id, code, error, (sum(error) OVER (PARTITION BY k.label))::BIGINT AS label_error, h AS codebooks_sha256
FROM coded c JOIN kept k ON k.vec_id = c.vec_id, books
"""


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the sources of each language diverge, in terms of 30 documents and more."""
    return divergence.audit(_table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents
), words AS (SELECT id, lang, source, unnest(t) AS term FROM d
), kept AS (SELECT lang, term FROM words GROUP BY ALL HAVING count(DISTINCT id) >= 30
), v AS (SELECT l.lang, count(k.term) AS v FROM (SELECT DISTINCT lang FROM d) l LEFT JOIN kept k ON k.lang = l.lang GROUP BY ALL
), g AS (SELECT DISTINCT lang, source FROM d
), c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM words w JOIN kept k ON k.lang = w.lang AND k.term = w.term GROUP BY ALL
), per AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN kept k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), gp AS (
  SELECT p.*, 1 + (1000000000 * (n + 5)::HUGEINT) // (t.total + 5 * v.v) AS p FROM per p
  JOIN (SELECT lang, source, sum(n) AS total FROM per GROUP BY ALL) t ON t.lang = p.lang AND t.source = p.source JOIN v ON v.lang = p.lang
), lq AS (
  SELECT a.lang, a.term, 1 + (1000000000 * (a.n + 5)::HUGEINT) // (t.total + 5 * v.v) AS q FROM (SELECT lang, term, sum(n) AS n FROM per GROUP BY ALL) a
  JOIN (SELECT lang, sum(n) AS total FROM per GROUP BY ALL) t ON t.lang = a.lang JOIN v ON v.lang = a.lang
), vecs AS (SELECT lang, source, list(p::BIGINT ORDER BY term) AS ps FROM gp GROUP BY ALL
), found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
    coalesce(list_sum(list_transform(list_zip(x.ps, y.ps), lambda z: abs(z[1] - z[2]))), 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN vecs x ON x.lang = a.lang AND x.source = a.source LEFT JOIN vecs y ON y.lang = b.lang AND y.source = b.source
  UNION ALL
  SELECT p.lang, p.source, 'term', p.term, (p.p - q.q)::BIGINT FROM gp p JOIN lq q ON q.lang = p.lang AND q.term = p.term WHERE p.n > 0 AND p.p > q.q
)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found
) WHERE part = 'pair' OR rank <= 50
"""


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The personal data in every document."""
    return pii.find(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
        "op2_exact_dedup": op2_exact_dedup,
        "op3_best_fit_packing": op3_best_fit_packing,
        "op4_lm_scoring": op4_lm_scoring,
        "op5_source_mixing": op5_source_mixing,
        "op6_language_id": op6_language_id,
        "op7_warc_assembly": op7_warc_assembly,
        "op8_exact_top_k": op8_exact_top_k,
        "op9_token_counts": op9_token_counts,
        "op10_sharding": op10_sharding,
        "op11_vector_codes": op11_vector_codes,
        "op12_source_divergence": op12_source_divergence,
        "op13_personal_data": op13_personal_data,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard_join": OP1_SQL, "op2_exact_dedup": OP2_SQL, "op7_warc_assembly": OP7_SQL, "op8_exact_top_k": OP8_SQL, "op10_sharding": _op10_sql(), "op11_vector_codes": _op11_sql(), "op12_source_divergence": OP12_SQL}
