import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from crossrank.llm import jaccard, language, pii, registry, substrings
from test_texts import ODD, brute_groups, brute_spans, brute_windows, check_packing

DATA = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def test_stages_against_brute_force(spark, docs):
    kept = cp.STAGES[0][1](spark, docs, DATA)
    assert kept.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    one = cp.STAGES[1][1](spark, kept, DATA)
    want = {i for i, (_, c) in brute_groups(rows).items() if i == c}
    assert {r.doc_id for r in one.collect()} == want and one.columns == docs.columns
    cut = cp.STAGES[2][1](spark, one, DATA)
    texts = dict(rows)
    expected = {i: (t if n else texts[i]) for i, _, n, t in brute_windows([(i, texts[i]) for i in want])}
    got = {r.doc_id: r for r in cut.collect()}
    assert {i: r.text for i, r in got.items()} == expected and all(r.n_chars == len(r.text) for r in got.values())
    clean = cp.STAGES[3][1](spark, cut, DATA)
    after = {r.doc_id: r.text for r in clean.collect()}
    assert all(not brute_spans(t) for t in after.values()) and all(after[i] == t for i, t in expected.items() if not brute_spans(t))
    check_packing(list(after.items()), cp.STAGES[4][1](spark, clean, DATA).collect())


def test_run_gives_the_stages_result(spark):
    got = cp.run(spark, DATA)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and got.count() > 0


def test_odd_rows_pass_through_every_stage(spark):
    odd = spark.createDataFrame([(i, t, "en" if k % 2 else None, None, None) for k, (i, t) in enumerate(ODD)], COLUMNS).withColumn("score", F.lit(3.5)).withColumn("lang_pred", F.lit("x"))
    seen = odd
    for name, stage in cp.STAGES[:-1]:
        new = stage(spark, seen, DATA)
        assert new.columns == odd.columns, name
        assert {r.score for r in new.collect()} == {3.5} and {r.lang_pred for r in new.collect()} == {"x"}
        seen = new
    ids = sorted(str(r.doc_id) for r in seen.collect())
    assert ids == sorted(["4", "5", "6", "7", "8", "8", "None"])
    assert cp.STAGES[-1][1](spark, seen, DATA).count() > 0
    empty = odd.limit(0)
    for name, stage in cp.STAGES:
        assert stage(spark, empty, DATA).count() == 0, name


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_queries_equal_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = registry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    rel = c.execute(registry.oracle_sql()[name])
    names = [x[0] for x in rel.description]
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in df.collect()))) == sorted(map(repr, (tuple(r[names.index(c)] for c in columns) for r in rel.fetchall())))


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql()) - {"pipeline"}))
def test_queries_give_a_row_for_each_input(spark, docs, name):
    got = registry.queries()[name](spark, DATA)
    if name == "op4_ann":
        assert got.groupBy("query_id").count().filter("count <> 10").count() == 0
    else:
        assert got.select("doc_id").distinct().count() == docs.count()


def test_modules_used():
    assert all(m.__doc__ for m in (jaccard, language, pii, substrings))
