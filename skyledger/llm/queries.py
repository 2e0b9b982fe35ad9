"""One query for each operator, with production parameters, over whole tables; and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import round_trip_digests

    return round_trip_digests(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(_table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import Mix

    return Mix(_table(spark, sf_dir, "documents")).taken()


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import read_archives, resolved, write_archives

    index = write_archives(_table(spark, sf_dir, "pages"))
    return resolved(read_archives(index)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
     q AS (SELECT page_id, strlen(body) AS payload_bytes, sha256(body) AS payload_digest, min(page_id) OVER (PARTITION BY body) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND first <> page_id THEN first END AS refers_to
FROM q
"""


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import assign

    return assign(_table(spark, sf_dir, "documents"))


OP6_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS body FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY body) AS kept, sha256(body) AS text_sha256
FROM t
"""


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licences import scan

    return scan(_table(spark, sf_dir, "documents"))


def op8_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_shards import read_shards, write_shards

    return read_shards(write_shards(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json")))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score, train

    documents = _table(spark, sf_dir, "documents")
    return score(documents, train(documents, _table(spark, sf_dir, "labels")))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest

    return nearest(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bpe_round_trip": op1_bpe_round_trip,
        "op2_token_counts": op2_token_counts,
        "op3_mixing": op3_mixing,
        "op4_warc": op4_warc,
        "op5_simhash": op5_simhash,
        "op6_exact_dedup": op6_exact_dedup,
        "op7_licences": op7_licences,
        "op8_token_shards": op8_token_shards,
        "op9_toxicity": op9_toxicity,
        "op10_nearest": op10_nearest,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_warc": OP4_SQL, "op6_exact_dedup": OP6_SQL}
