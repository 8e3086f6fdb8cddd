"""The fixtures and the chain of operators in DuckDB SQL, to check the Spark plans against."""

from __future__ import annotations

from crossrank.functions.text import SPACE, STATIC_PATTERNS, STOPWORDS

METRICS = ("Recall@1", "Recall@3", "Recall@5", "Recall@10", "MRR@10", "mAP@10")


def unit(x: str) -> str:
    return f"list_transform({x}, lambda a: a / greatest(sqrt(list_dot_product({x}, {x})), 1e-12))"


def r6(x: str) -> str:
    return f"round({x}, 6) + 0.0"


VECTORS = """e AS (SELECT vec_id, CAST(label AS BIGINT) AS label, CAST(embedding AS DOUBLE[]) AS emb, CAST(label * 4 + vec_id % 4 AS BIGINT) AS slide_id FROM embeddings),
v AS (SELECT *, row_number() OVER (PARTITION BY slide_id ORDER BY vec_id) AS rn FROM e)"""

SLIDES = """slides AS (SELECT DISTINCT slide_id, slide_id // 2 AS case_id, slide_id // 4 AS oncotree, slide_id // 8 AS project,
  CASE WHEN (slide_id // 2) % 5 < 2 THEN 'train' WHEN (slide_id // 2) % 5 = 2 THEN 'val' ELSE 'test' END AS split FROM v)"""


def pairs(backbones=("B64",), scenarios=("strict",), splits=()) -> str:
    """Common table expressions up to ``pairs`` (backbone, scenario, slide_id, report_id, s_g, s_p)."""
    size = {"B64": 64, "B32": 32}
    rn = {"original": 1, "strict": 2, "diagnosis_only": 3}
    bb = " UNION ALL ".join(f"SELECT '{b}' AS backbone, {size[b]} AS d" for b in backbones)
    sc = " UNION ALL ".join(f"SELECT '{s}' AS scenario, {rn[s]} AS k" for s in scenarios)
    keep = f"WHERE split IN ({', '.join(repr(s) for s in splits)})" if splits else ""
    return f"""{VECTORS}, {SLIDES},
kept AS (SELECT slide_id FROM slides {keep}),
bb AS ({bb}), sc AS ({sc}),
cut AS (SELECT backbone, slide_id, rn, list_slice(emb, 1, d) AS c FROM v JOIN kept USING (slide_id), bb),
vb AS (SELECT backbone, slide_id, rn, {unit('c')} AS u FROM cut),
dims AS (SELECT backbone, slide_id, unnest(u) AS x, generate_subscripts(u, 1) AS j FROM vb WHERE rn > 3),
per_dim AS (SELECT backbone, slide_id, j, avg(x) AS m, max(x) AS top FROM dims GROUP BY ALL),
lists AS (SELECT backbone, slide_id, list(m ORDER BY j) AS m, list(top ORDER BY j) AS top FROM per_dim GROUP BY ALL),
pool AS (SELECT backbone, slide_id, {unit('m')} AS mean_pool, {unit('top')} AS max_pool FROM lists),
rep AS (SELECT backbone, scenario, slide_id AS report_id, u FROM vb JOIN sc ON rn = k),
sg AS (SELECT p.backbone, scenario, p.slide_id, report_id, list_dot_product(mean_pool, u) AS s_g FROM pool p JOIN rep r ON p.backbone = r.backbone),
sp AS (SELECT p.backbone, scenario, p.slide_id, report_id, max(list_dot_product(p.u, r.u)) AS s_p FROM vb p JOIN rep r ON p.backbone = r.backbone WHERE p.rn > 3 GROUP BY ALL),
pairs AS (SELECT backbone, scenario, slide_id, report_id, s_g, s_p FROM sg JOIN sp USING (backbone, scenario, slide_id, report_id))"""


def calibrated(**kw) -> str:
    """Up to ``cal``: both directions with the four terms."""
    axes = {"d": "query_id", "r": "cand_id"}
    w = lambda a: f"OVER (PARTITION BY backbone, scenario, direction, {axes[a]})"
    terms = [(a, s) for a in "dr" for s in "gp"]
    scaled = ", ".join(f"s_{s} / greatest(stddev_pop(s_{s}) {w(a)}, 1e-8) AS y_{a}{s}" for a, s in terms)
    top = ", ".join(f"max(y_{a}{s}) {w(a)} AS m_{a}{s}" for a, s in terms)
    fin = ", ".join(f"y_{a}{s} - (m_{a}{s} + ln(sum(exp(y_{a}{s} - m_{a}{s})) {w(a)})) AS {a}_{s}" for a, s in terms)
    return f"""{pairs(**kw)},
ways AS (SELECT backbone, scenario, 'I2T' AS direction, slide_id AS query_id, report_id AS cand_id, s_g, s_p FROM pairs
  UNION ALL SELECT backbone, scenario, 'T2I', report_id, slide_id, s_g, s_p FROM pairs),
scaled AS (SELECT *, {scaled} FROM ways), tops AS (SELECT *, {top} FROM scaled),
cal AS (SELECT backbone, scenario, direction, query_id, cand_id, s_g, s_p, {fin} FROM tops)"""


SCORES = {
    "mean_pooling": "s_g",
    "global_only": "r_g",
    "second_calibrated_channel": "r_g + 0.5 * (d_g + r_g)",
    "local_only": "0.5 * (d_p + r_p)",
    "global_plus_reciprocal_local": "r_g + r_p",
    "global_plus_direct_local": "r_g + d_p",
    "rerank": "r_g + 0.5 * (d_p + r_p)",
}


def variants(only=tuple(SCORES)) -> str:
    """``scored``, from ``cal``: a score for each variant."""
    parts = " UNION ALL ".join(f"SELECT backbone, scenario, direction, query_id, cand_id, '{n}' AS variant, {SCORES[n]} AS score FROM cal" for n in only)
    return f"scored AS ({parts})"


def metrics(granularities=("oncotree",), src: str = "scored", own: bool = False, cond: str = "backbone, scenario, direction, variant") -> str:
    """``pq``, from scored pairs: metrics of each query by granularity; ``own``: the query's own item goes last."""
    k = {"oncotree": 4, "project": 8}
    g = " UNION ALL ".join(f"SELECT '{n}' AS granularity, {k[n]} AS k" for n in granularities)
    score = "CASE WHEN query_id = cand_id THEN CAST('-inf' AS DOUBLE) ELSE round(score, 9) END" if own else "round(score, 9)"
    hit = lambda n: f"CAST(max(CASE WHEN rank <= {n} THEN rel ELSE 0 END) AS DOUBLE)"
    m = [*(hit(n) for n in (1, 3, 5, 10)), "coalesce(1.0 / min(CASE WHEN rel = 1 THEN rank END), 0.0)", "sum(CASE WHEN rel = 1 THEN CAST(hits AS DOUBLE) / rank ELSE 0.0 END) / least(max(total), max(n), 10)"]
    named = ", ".join(f'CASE WHEN max(total) > 0 THEN {x} END AS "{n}"' for x, n in zip(m, METRICS, strict=True))
    return f"""gr AS ({g}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY {cond}, query_id ORDER BY {score} DESC, cand_id) AS rank, count(*) OVER (PARTITION BY {cond}, query_id) AS n FROM {src}),
tot AS (SELECT granularity, slide_id // k AS label, count(*) - {int(own)} AS total FROM kept, gr GROUP BY ALL),
rel AS (SELECT ranked.*, granularity, query_id // k AS label, CAST(query_id // k = cand_id // k AS INT) AS rel FROM ranked, gr WHERE rank <= 10),
run AS (SELECT *, sum(rel) OVER (PARTITION BY {cond}, granularity, query_id ORDER BY rank) AS hits FROM rel),
pq AS (SELECT {cond}, granularity, query_id, label, max(total) > 0 AS eligible, {named} FROM run JOIN tot USING (granularity, label) GROUP BY {cond}, granularity, query_id, label)"""


def classes(cond: str = "backbone, scenario, direction, variant, granularity") -> str:
    avg = ", ".join(f'avg("{m}") AS "{m}"' for m in METRICS)
    return f"""cl AS (SELECT {cond}, label AS class, count(*) AS n_class, {avg} FROM pq WHERE eligible GROUP BY {cond}, label),
mac AS (SELECT {cond}, {avg} FROM cl GROUP BY {cond})"""


def rounded_metrics(names=METRICS) -> str:
    return ", ".join(f'{r6(chr(34) + m + chr(34))} AS "{m}"' for m in names)


TEXTS = """rt AS (SELECT doc_id AS slide_id, CAST(doc_id AS VARCHAR) AS case_id, source AS project_id, text AS slide_reports,
  array_to_string(list_slice(list_filter(regexp_split_to_array(text, '[\\t-\\r ]+'), lambda w: w <> ''), 1, 3), ' ') AS cancer_type_detailed,
  lang AS site_of_resection_or_biopsy, CASE WHEN doc_id % 3 = 0 THEN substr(text, 1, 30) END AS slide_reports_no_diagnosis_strict FROM documents),
au AS (SELECT slide_id, case_id, project_id, slide_reports AS original_slide_reports, slide_id % 21 = 0 AS excluded_insufficient_source,
  CASE WHEN slide_id % 21 = 0 THEN '' ELSE 'Rewritten ' || substr(slide_reports, 1, 40) END AS rewritten_text,
  slide_id % 14 = 0 AS leakage_flag_after_retries, CAST(1 AS INTEGER) AS attempts_used FROM rt WHERE slide_id % 7 = 0),
li AS (SELECT doc_id AS slide_id FROM labels UNION ALL SELECT doc_id + 1000000000 FROM labels WHERE doc_id % 10 = 0)"""

_SPACE = SPACE.replace(r"\x{85}", r"\x{0085}")


def one_paragraph(x: str) -> str:
    flat = f"regexp_replace(replace(coalesce({x}, ''), chr(13), chr(10)), '[ \\t]+', ' ', 'g')"
    return f"regexp_replace(regexp_replace(replace({flat}, chr(10), ' '), '{_SPACE}{{2,}}', ' ', 'g'), '^{_SPACE}+|{_SPACE}+$', '', 'g')"


def ensure_period(x: str) -> str:
    return f"CASE WHEN {x} = '' OR regexp_matches({x}, '[.!?]$') THEN {x} ELSE {x} || '.' END"


def static_hits(text: str) -> str:
    """A list with each static pattern that matches, null for the others.

    RE2 has ASCII word borders, so the borders are spelled out.
    """

    def portable(p: str) -> str:
        body = p.replace(r"(?!\w)", "").removeprefix(r"\b").removesuffix(r"\b").replace(r"\w", r"[\p{L}\p{N}_]")
        return rf"(^|[^\p{{L}}\p{{N}}_])(?:{body})($|[^\p{{L}}\p{{N}}_])"

    return "[" + ", ".join(f"CASE WHEN regexp_matches({text}, '{portable(p)}', 'i') THEN '{p}' END" for p in STATIC_PATTERNS) + "]"


def stopwords() -> str:
    return ", ".join(f"'{w}'" for w in STOPWORDS)


def terms(a: str, b: str) -> str:
    words = f"list_transform(list_concat(regexp_split_to_array(coalesce({a}, ''), '[^A-Za-z]+'), regexp_split_to_array(coalesce({b}, ''), '[^A-Za-z]+')), lambda w: lower(w))"
    return f"list_sort(list_distinct(list_filter({words}, lambda w: len(w) >= 4 AND w NOT IN ({stopwords()}))))"


def md5_number(s: str) -> str:
    return f"CAST('0x' || substr(md5({s}), 1, 8) AS BIGINT)"
