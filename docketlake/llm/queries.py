"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketlake.llm.bpe import bpe_digests
from docketlake.llm.common import fold, in_fold, new_path, written
from docketlake.llm.exact_dedup import exact_dedup
from docketlake.llm.language_id import identify_language, train_languages
from docketlake.llm.lexical_search import ranked_search
from docketlake.llm.lm_scoring import lm_scores
from docketlake.llm.ngram_join import similar_components
from docketlake.llm.packing import pack_pieces, token_pieces
from docketlake.llm.periodic_runs import periodic_runs, repeated_tail, run_digests
from docketlake.llm.pii import find_pii, span_digests
from docketlake.llm.quality import score_quality, train_quality
from docketlake.llm.token_counts import token_counts
from docketlake.llm.token_files import read_token_files, write_token_files
from docketlake.llm.top_k import top_inner_products

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(documents(spark, sf_dir))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = token_pieces(documents(spark, sf_dir), WORD_BPE)
    digests = pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return pack_pieces(written(digests, "pieces"))


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_inner_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(documents(spark, sf_dir), WORD_BPE)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digests(find_pii(documents(spark, sf_dir)))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir), keep="max")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir).select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    scored = score_quality(docs, train_quality(docs, labels.filter(fold("doc_id", 3) != 1)))
    return scored.select("doc_id", in_fold("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    field = train_languages(docs.filter(fold("doc_id", 4) != 2))
    return identify_language(docs, field).select("doc_id", in_fold("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), WORD_BPE)


OP6_SQL = """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm_scores(documents(spark, sf_dir), fold("doc_id", 10) != 0, WORD_BPE)
    return scored.select("doc_id", in_fold("doc_id", 10, 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-files")
    write_token_files(documents(spark, sf_dir), WORD_BPE, path, end_id=2)
    return read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(periodic_runs(documents(spark, sf_dir), repeated_tail))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH words AS (
    SELECT row_number() OVER () AS row_id, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents
), wanted AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark WHERE item_id IS NOT NULL
), whole AS (
    SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(len(terms)) AS BIGINT) AS all_terms FROM words WHERE len(terms) > 0
), tf AS (
    SELECT row_id, doc_id, term, CAST(count(*) AS BIGINT) AS tf, any_value(n) AS n
    FROM (SELECT row_id, doc_id, CAST(len(terms) AS BIGINT) AS n, unnest(terms) AS term FROM words)
    WHERE term IN (SELECT term FROM wanted)
    GROUP BY row_id, doc_id, term
), weight AS (
    SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, whole GROUP BY term, docs
), part AS (
    SELECT row_id, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * docs) // all_terms)))) AS part
    FROM tf JOIN weight USING (term), whole
), scored AS (
    SELECT item_id, row_id, doc_id, CAST(sum(part) AS BIGINT) AS score FROM wanted JOIN part USING (term) WHERE doc_id IS NOT NULL GROUP BY item_id, row_id, doc_id
), ranked AS (
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""


OP3_SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
    FROM embeddings
    WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
    FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_join": op1_ngram_join,
        "op2_packing": op2_packing,
        "op3_top_k": op3_top_k,
        "op4_bpe": op4_bpe,
        "op5_pii": op5_pii,
        "op6_exact_dedup": op6_exact_dedup,
        "op7_quality": op7_quality,
        "op8_language": op8_language,
        "op9_token_counts": op9_token_counts,
        "op10_lm_scoring": op10_lm_scoring,
        "op11_token_files": op11_token_files,
        "op12_periodic_runs": op12_periodic_runs,
        "op13_lexical_search": op13_lexical_search,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_top_k": OP3_SQL, "op6_exact_dedup": OP6_SQL, "op13_lexical_search": OP13_SQL}
