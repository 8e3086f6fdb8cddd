"""Queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from crossrank.llm.ann import op4_ann
from crossrank.llm.jaccard import op6_jaccard
from crossrank.llm.language import op7_language
from crossrank.llm.packing import op5_packing
from crossrank.llm.pii import op3_pii
from crossrank.llm.quality import op2_quality
from crossrank.llm.substrings import op1_substrings
from crossrank.llm.tokens import op9_bpe
from crossrank.llm.topk import op8_topk
from crossrank.llm.toxicity import op10_toxicity


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substrings": op1_substrings,
        "op2_quality": op2_quality,
        "op3_pii": op3_pii,
        "op4_ann": op4_ann,
        "op5_packing": op5_packing,
        "op6_jaccard": op6_jaccard,
        "op7_language": op7_language,
        "op8_topk": op8_topk,
        "op9_bpe": op9_bpe,
        "op10_toxicity": op10_toxicity,
        "pipeline": pipeline,
    }


#: Words of each text: runs of anything but blank and the five control characters from tab to carriage return.
_WORDS = "list_filter(regexp_split_to_array(coalesce({}, ''), '[\\x09-\\x0D\\x20]+'), lambda x: x <> '')"

_OP1 = f"""
WITH words AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) AS i FROM words WHERE len(w) >= 13),
win AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS g FROM starts),
least AS (SELECT g, min(doc_id) AS f FROM win GROUP BY g),
hit AS (SELECT win.doc_id, i FROM win JOIN least USING (g) WHERE f < win.doc_id),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(generate_series(i, i + 12)) AS p FROM hit)),
each AS (SELECT doc_id, unnest(w) AS x, unnest(generate_series(1, len(w))) AS p FROM words),
kept AS (SELECT each.doc_id, string_agg(x, ' ' ORDER BY each.p) AS t, count(*) AS n
         FROM each ANTI JOIN gone ON each.doc_id = gone.doc_id AND each.p = gone.p GROUP BY each.doc_id)
SELECT words.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM words LEFT JOIN kept ON words.doc_id = kept.doc_id"""

_OP6 = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, {_WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT words.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(words.doc_id, coalesce(m, words.doc_id)) AS component_id
FROM words LEFT JOIN sizes ON words.doc_id = sizes.doc_id LEFT JOIN least ON words.doc_id = least.a"""

_OP8 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""


def oracle_sql() -> dict[str, str]:
    return {"op1_substrings": _OP1, "op6_jaccard": _OP6, "op8_topk": _OP8}
