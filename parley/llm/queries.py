"""The registered queries of this subpackage, with production parameters over
whole tables, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm import (bpe, hamming, language, linededup, negatives, packing, quality, simhash, suffix, tokencount, toxicity,
                        vectorcodes, warc)

#: Tokenizer files are named by their owner package; any path works.
WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), WORD_VOCABULARY)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), WORD_VOCABULARY)


def op4_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming.nearest(table(spark, sf_dir, "embeddings"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"), WORD_VOCABULARY)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.line_dedup(docs, counts=True).select(
        "doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op10_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix.remove_repeats(docs, counts=True).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.compress(table(spark, sf_dir, "embeddings"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(negatives.relabelled(table(spark, sf_dir, "embeddings")))


def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.predict(docs, language.fit(docs))


# Lines of every document, all windows of three, later occurrences, covered lines.
LINE_DEDUP_SQL = """
WITH split AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, i - 1 AS pos, ls[i] AS line
          FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM split)),
grams AS (SELECT a.doc_id, a.pos, a.line || chr(10) || b.line || chr(10) || c.line AS gram
          FROM lines a JOIN lines b ON b.doc_id = a.doc_id AND b.pos = a.pos + 1
          JOIN lines c ON c.doc_id = a.doc_id AND c.pos = a.pos + 2),
ranked AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY gram ORDER BY doc_id, pos) AS k FROM grams),
covered AS (SELECT DISTINCT doc_id, pos + o AS pos FROM ranked, (SELECT unnest([0, 1, 2]) AS o) WHERE k > 1),
kept AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) AS text
         FROM lines l LEFT JOIN covered c ON c.doc_id = l.doc_id AND c.pos = l.pos
         WHERE c.pos IS NULL GROUP BY l.doc_id),
n AS (SELECT doc_id, count(*) AS n_removed FROM covered GROUP BY doc_id)
"""

def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_pipeline import run

    return run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_bpe": op2_bpe,
    "op3_packing": op3_packing,
    "op4_hamming_topk": op4_hamming_topk,
    "op5_toxicity": op5_toxicity,
    "op6_token_counts": op6_token_counts,
    "op7_simhash": op7_simhash,
    "op8_warc": op8_warc,
    "op9_line_dedup": op9_line_dedup,
    "op10_suffix_array": op10_suffix_array,
    "op11_vector_codes": op11_vector_codes,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_language": op13_language,
    "pipeline": pipeline,
}

# Every query against every other row.
HAMMING_SQL = """
WITH bits AS (SELECT vec_id, i, embedding[i] > 0 AS b FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)),
pairs AS (SELECT q.vec_id AS query_id, r.vec_id AS neighbour_id, CAST(sum(CASE WHEN q.b <> r.b THEN 1 ELSE 0 END) AS INTEGER) AS distance
          FROM bits q JOIN bits r ON r.i = q.i WHERE q.vec_id % 100 = 0 AND q.vec_id <> r.vec_id GROUP BY 1, 2),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id) AS INTEGER) AS rank FROM pairs)
SELECT query_id, rank, neighbour_id, distance FROM ranked WHERE rank <= 10
"""

COMPLETE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def vector_codes_sql() -> str:
    """Every part against every entry, round after round."""
    distance = "list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - b.x[i]) * (p.x[i] - b.x[i])))"
    near = (f"SELECT p.vec_id, p.part, p.x, arg_min(b.entry, row({distance}, b.entry)) AS entry, min({distance}) AS d "
            "FROM parts p JOIN BOOK b ON b.part = p.part GROUP BY p.vec_id, p.part, p.x")
    steps = [f"""kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
           FROM embeddings WHERE {COMPLETE})""", """
parts AS MATERIALIZED (SELECT vec_id, part, v[part * (len(v) // 8) + 1:(part + 1) * (len(v) // 8)] AS x
                       FROM kept, (SELECT unnest(range(8)) AS part))""", """
book0 AS MATERIALIZED (SELECT part, entry, x FROM parts JOIN
          (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT 16) USING (vec_id))"""]
    for k in range(vectorcodes.ROUNDS):
        steps.append(f"\nnear{k} AS MATERIALIZED ({near.replace('BOOK', f'book{k}')})")
        steps.append(f"""
means{k} AS (SELECT part, entry, list(m ORDER BY i) AS x FROM (
    SELECT part, entry, i, CAST(floor(sum(c) / count(*)) AS BIGINT) AS m
    FROM (SELECT part, entry, unnest(x) AS c, unnest(range(len(x))) AS i FROM near{k}) GROUP BY part, entry, i) GROUP BY part, entry)""")
        steps.append(f"""
book{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM book{k} b LEFT JOIN means{k} m USING (part, entry))""")
    last = f"book{vectorcodes.ROUNDS}"
    steps.append(f"""
coded AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error
          FROM ({near.replace('BOOK', last)}) GROUP BY vec_id)""")
    steps.append(f"""
digest AS (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, entry, i)) AS codebooks_sha256
           FROM (SELECT part, entry, unnest(x) AS c, unnest(range(len(x))) AS i FROM {last}))""")
    return "WITH " + ",".join(steps) + """
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN kept USING (vec_id), digest
"""


# Every anchor against every other row.
HARD_NEGATIVES_SQL = f"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS ints
           FROM embeddings WHERE label IS NOT NULL AND {COMPLETE}),
scored AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
                  CAST(list_dot_product(a.ints, b.ints) AS BIGINT) AS score
           FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
positives AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM scored WHERE same
              QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.other) AS INTEGER) AS rank,
       n.other AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
  AND 50 * p.positive_score <= 100 * n.score AND 100 * n.score <= 95 * p.positive_score
QUALIFY rank <= 3
"""

ORACLE: dict[str, str] = {
    "op11_vector_codes": vector_codes_sql(),
    "op12_hard_negatives": HARD_NEGATIVES_SQL,
    "op4_hamming_topk": HAMMING_SQL,
    "op9_line_dedup": LINE_DEDUP_SQL + """
SELECT s.doc_id, CAST(len(s.ls) AS BIGINT) AS n_lines, CAST(coalesce(n.n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.text, '')) AS kept_sha256
FROM split s LEFT JOIN kept k ON k.doc_id = s.doc_id LEFT JOIN n ON n.doc_id = s.doc_id
""",
}
