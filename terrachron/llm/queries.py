"""The registered queries of the corpus operators, and DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, html, langid, neardup, packing, pii, secrets, tokens, topk, toxicity
from .common import crc_fold


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in all documents, through an FM-index per shard."""
    found = decontam.find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP1_SQL = r"""
WITH bw AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL
), iw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS win
  FROM bw, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS t(i) WHERE len(w) > 0
), dw AS (
  SELECT row_number() OVER () AS k, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), found AS (
  SELECT d.k, d.i, d.n, iw.item_id FROM (
    SELECT k, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
    FROM dw, (SELECT DISTINCT n FROM iw) AS ns, unnest(range(1, len(w) - n + 2)) AS t(i) WHERE len(w) >= n
  ) AS d JOIN iw ON d.n = iw.n AND d.win = iw.win
), hit AS (
  SELECT k, count(DISTINCT p) AS n_hit FROM found, unnest(range(i, i + n)) AS t(p) GROUP BY k
), items AS (
  SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT k, item_id::VARCHAR AS item FROM found) GROUP BY k
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (k) LEFT JOIN items USING (k)
"""



def _span_list(kinds: str = "kinds", starts: str = "starts", ends: str = "ends") -> Column:
    """Three arrays as an array of kind:start:end, in their order."""
    return F.transform(
        F.arrays_zip(F.col(kinds).alias("k"), F.col(starts).alias("a"), F.col(ends).alias("e")),
        lambda s: F.concat_ws(":", s["k"], s["a"], s["e"]),
    )


def _of_kinds(spans: Column, kinds: tuple[str, ...]) -> Column:
    return F.filter(spans, lambda s: F.substring_index(s, ":", 1).isin(*kinds))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents; the kinds after ``hex`` are those that structure confirms."""
    base = secrets.KINDS[:3]
    df = secrets.find_secrets(_table(spark, sf_dir, "documents")).withColumn("s", _span_list())
    return df.select(
        "doc_id",
        *[F.size(_of_kinds(F.col("s"), (k,))).cast("long").alias(f"n_{k}") for k in base],
        F.sha2(F.array_join(_of_kinds(F.col("s"), base), ","), 256).alias("base_sha256"),
        F.array_join("s", ",").alias("spans"),
    )


def toxic_lexicon(docs: DataFrame, labels: DataFrame) -> toxicity.Lexicon:
    """The lexicon learned without the held-out fold of the labels."""
    return toxicity.learn_lexicon(docs, labels.where(crc_fold("doc_id", 3) != 1))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents; one fold of three of the labels is never learned from."""
    docs = _table(spark, sf_dir, "documents")
    found = toxicity.score_toxicity(docs, toxic_lexicon(docs, _table(spark, sf_dir, "labels")))
    return found.select(
        "doc_id",
        F.coalesce(crc_fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


def op9_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    return tokens.count_tokens(_table(spark, sf_dir, "documents"), path).withColumn("over_limit", F.col("n_tokens") > 4096)


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return html.extract(_table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents; base spans are those of strict patterns."""
    docs = _table(spark, sf_dir, "documents")
    df = pii.find_personal_data(docs, pii.learn(docs)).withColumn("s", _span_list())
    base = F.transform(F.filter(F.arrays_zip("s", "strict"), lambda x: x["strict"]), lambda x: x["s"])
    df = df.withColumn("b", base)
    return df.select(
        "doc_id",
        *[F.size(_of_kinds(F.col("b"), (k,))).cast("long").alias(f"n_{k}") for k in pii.BASE],
        F.sha2(F.array_join("b", ","), 256).alias("base_sha256"),
        F.array_join("s", ",").alias("spans"),
    )


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    import public_tokenizers

    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of all documents, and their links to different texts."""
    return neardup.with_class_ids(neardup.classes(_table(spark, sf_dir, "documents")))


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best inner products of every 20th vector over all vectors, components times 64 as integers."""

    def whole(x: Column) -> Column:
        x = x.cast("double")
        return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), F.floor(x * 64).cast("double"))

    v = _table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", whole).alias("v"))
    return topk.top_k(v, v.where(F.col("vec_id") % 20 == 0), k=20)


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v AS q JOIN v AS c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents; one fold of four of the labels is never learned from."""
    fold = crc_fold("doc_id", 4)
    docs = _table(spark, sf_dir, "documents")
    found = langid.learn_and_identify(docs, fold != 2)
    return found.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_secrets": op2_secrets,
    "op3_main_text": op3_main_text,
    "op4_personal_data": op4_personal_data,
    "op5_packing": op5_packing,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_top_k": op7_top_k,
    "op8_toxicity": op8_toxicity,
    "op9_tokens": op9_tokens,
    "op10_language": op10_language,
}

SQL: dict[str, str] = {"op1_decontamination": OP1_SQL, "op7_top_k": OP7_SQL}
