import json

import duckdb
import pytest
from pyspark.sql import functions as F

from crossrank.operators import cohort, rewriting, spatial
from crossrank.plans import catalogue
from crossrank.streaming.rewriting import rewrite_stream

REPORTS = "slide_id long, case_id string, project_id string, slide_reports string, cancer_type_detailed string, site_of_resection_or_biopsy string, slide_reports_no_diagnosis_strict string"


def reports(spark, *texts):
    return spark.createDataFrame([(i, f"c{i}", "p", t, "Ductal Carcinoma", "Breast", None) for i, t in enumerate(texts)], REPORTS)


LONG = "Sheets of cells with round nuclei and clear cytoplasm fill the ducts."


def test_rewriting_retries_until_clean(spark):
    df = reports(spark, LONG, LONG + " Invasive carcinoma, grade 3, of the breast.", "short", None)
    got = {r.slide_id: r for r in rewriting.rewrite(df).collect()}
    assert got[0].attempts_used == 1 and not got[0].leakage_flag_after_retries and got[0].rewritten_text == LONG
    assert got[1].attempts_used == 2 and got[1].rewritten_text.endswith(".") and got[1].remaining_matched_terms == []
    assert "breast" in got[1].removed_terms and got[1].removed_terms == sorted(got[1].removed_terms)
    for k in (2, 3):
        assert got[k].excluded_insufficient_source and got[k].rewritten_text == "" and got[k].attempts_used == 1


def test_rewriter_that_never_complies_is_flagged(spark):
    say = lambda instructions, text: json.dumps({"has_sufficient_morphology": True, cohort.REWRITE: "A carcinoma with many cells"})
    r = rewriting.rewrite(reports(spark, LONG), say, 3).first()
    assert r.leakage_flag_after_retries and r.attempts_used == 3 and r.remaining_matched_terms == [r"\bcarcinoma\b", "carcinoma"]


def test_backoff_waits_and_gives_up():
    waits, left = [], [rewriting.RateLimited("try again in 3s"), rewriting.RateLimited("busy"), TimeoutError()]

    def call(a, b):
        if left:
            raise left.pop(0)
        return "ok"

    assert rewriting.with_backoff(call, 4, waits.append)("", "") == "ok" and waits == [5, 30, 10]

    def down(a, b):
        raise ConnectionError

    with pytest.raises(ConnectionError):
        rewriting.with_backoff(down, 2, waits.append)("", "")
    many = iter([rewriting.RateLimited("busy")] * 500)

    def busy(a, b):
        for e in many:
            raise e
        return "at last"

    waits.clear()
    assert rewriting.with_backoff(busy, sleep=waits.append)("", "") == "at last" and waits == [30] * 500  # for as long as it takes


def test_a_rewriter_is_named_by_module_and_function():
    assert rewriting.load("crossrank.operators.rewriting:stub") is rewriting.stub
    with pytest.raises(ValueError, match="module:function"):
        rewriting.load("crossrank.operators.rewriting")


def test_reply_schema(spark):
    df = spark.createDataFrame([('{"has_sufficient_morphology": true, "slide_reports_no_diagnosis_strict": "x"}',), ("no json",)], "r string")
    got = [r[0] for r in df.select(rewriting.parsed_reply(F.col("r"))).collect()]
    assert got[0].has_sufficient_morphology is True and (got[1] is None or got[1].has_sufficient_morphology is None)


def test_resume_overwrite_and_backfill(spark):
    df = reports(spark, LONG, LONG, LONG, " \n ", None).withColumn(cohort.REWRITE, F.when(F.col("slide_id") == 0, "A text that is useful"))
    audit = spark.createDataFrame([(1, "Rewritten, and long enough", False), (2, "", True)], "slide_id long, rewritten_text string, excluded_insufficient_source boolean")
    assert cohort.to_process(df, audit).count() == 0
    assert [r.slide_id for r in cohort.to_process(df, audit.limit(0)).orderBy("slide_id").collect()] == [1, 2]
    assert cohort.to_process(df, audit, overwrite=True).count() == 3 and cohort.kept_audit(audit, df, overwrite=True).count() == 0
    filled = {r.slide_id: r[cohort.REWRITE] for r in cohort.backfill(df, audit).collect()}
    assert filled == {0: "A text that is useful", 1: "Rewritten, and long enough", 2: None, 3: None, 4: None}


def test_lookup_raises_on_missing_keys(spark):
    rows, table = spark.createDataFrame([(1,), (2,)], "slide_id long"), spark.createDataFrame([(1, "a")], "slide_id long, label string")
    assert cohort.lookup(rows.filter("slide_id = 1"), table).first().label == "a"
    with pytest.raises(Exception, match="no slide_id 2"):
        cohort.lookup(rows, table).collect()


def test_pilot_takes_from_each_project(spark):
    df = spark.createDataFrame([(i, "big" if i < 90 else "small" if i < 93 else None) for i in range(100)], "slide_id long, project_id string")
    got = cohort.stratified_pilot(df, 10, 1).collect()
    assert len(got) == 10 and {r.project_id for r in got} == {"big", "small"}
    assert cohort.stratified_pilot(df, 10, 1).collect() == got and cohort.stratified_pilot(df.limit(0), 5).count() == 0


def test_spatial(spark):
    md = spark.createDataFrame([("Scan|AppMag = 40|MPP = 0.25",)], "d string").select(spatial.slide_metadata(F.col("d")).alias("m"))
    r = md.select("m.*", spatial.footprint(F.lit(512), F.col("m.mpp"), F.col("m.app_mag")).alias("f")).first()
    assert (r.app_mag, r.mpp, r.f.patch_um, r.f.px_20x) == (40.0, 0.25, 128.0, 256.0)
    blank = spark.createDataFrame([(0, 0, 255, 255, 255)], "y int, x int, r int, g int, b int")
    with pytest.raises(Exception, match="no tissue"):
        spatial.tissue_box(blank).collect()
    points = spark.createDataFrame([(0.0, 0.0), (50.0, 5.0)], "px double, py double")
    assert tuple(spatial.check_inside(points, F.lit(10), F.lit(10), F.lit(2), F.lit(2)).first()) == (1, 2)


def test_tissue_of_a_long_image(spark, tmp_path):
    """Three dark lines of 1001 are too small a share of any column: the query gives its SQL's nulls, the operator an error."""
    spark.range(100_100).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0)).alias("embedding"), F.lit(0).alias("label")).write.parquet(f"{tmp_path}/embeddings.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = duck.execute(catalogue.SQL["q_tissue_bbox"]).fetchall()
    assert [tuple(r) for r in catalogue.q_tissue_bbox(spark, str(tmp_path)).collect()] == want == [(1, 3, None, None)]
    slides = spark.createDataFrame([(1, 0, 0, 9, 9, 9), (2, 0, 0, 255, 255, 255)], "slide_id int, y int, x int, r int, g int, b int")
    assert sorted(map(tuple, spatial.tissue_span(slides, ("slide_id",)).collect())) == [(1, 0, 0, 0, 0), (2, None, None, None, None)]
    assert tuple(spatial.tissue_box(slides.filter("slide_id = 1"), ("slide_id",)).first()) == (1, 0, 0, 0, 0)
    with pytest.raises(Exception, match="no tissue"):
        spatial.tissue_box(slides, ("slide_id",)).collect()


def test_streamed_rewriting(spark, tmp_path):
    df = reports(spark, LONG, LONG)
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    for _ in range(2):  # the second run finds nothing new
        rewrite_stream(stream, f"{tmp_path}/audit", f"{tmp_path}/checkpoint", rewriting.stub).awaitTermination()
    assert spark.read.json(f"{tmp_path}/audit").count() == 2
