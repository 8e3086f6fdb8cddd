"""Slides, patches and reports made of the ``embeddings`` table, by rules that SQL can state as well."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crossrank.functions.vectors import unit
from crossrank.operators.pooling import pool
from crossrank.operators.similarity import directed, similarities

SCENARIOS = ("original", "strict", "diagnosis_only")
#: Components that a backbone's vectors keep.
BACKBONES = {"B64": 64, "B32": 32}
#: Slides that share a label, by granularity: a label is a slide's number over this.
GRANULARITIES = {"oncotree": 4, "project": 8}
SLIDES = 40


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vec_id, label, slide_id, rn, emb``: rows 1 to 3 of a slide are its reports, the rest its patches."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("emb"))
    e = e.withColumn("slide_id", F.col("label") * 4 + F.col("vec_id") % 4)
    return e.withColumn("rn", F.row_number().over(Window.partitionBy("slide_id").orderBy("vec_id")).cast("long"))


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).filter("rn > 3").select("slide_id", (F.col("rn") - 4).alias("patch_idx"), "vec_id", "emb")


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.element_at(F.array(*map(F.lit, SCENARIOS)), F.col("rn").cast("int"))
    return vectors(spark, sf_dir).filter("rn <= 3").select(named.alias("scenario"), "slide_id", "emb")


def label_slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large slides: all vectors of a label are its patches."""
    e = read(spark, sf_dir, "embeddings")
    order = Window.partitionBy("slide_id").orderBy("vec_id")
    return e.select(F.col("label").cast("long").alias("slide_id"), "vec_id", F.col("embedding").cast("array<double>").alias("emb")).withColumn("patch_idx", (F.row_number().over(order) - 1).cast("long"))


def slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``slide_id, gallery_pos, case_id, split, oncotree, project``."""
    case = F.floor(F.col("slide_id") / 2)
    split = F.when(case % 5 < 2, "train").when(case % 5 == 2, "val").otherwise("test")
    ids = vectors(spark, sf_dir).select("slide_id").distinct()
    return ids.select("slide_id", F.col("slide_id").alias("gallery_pos"), case.alias("case_id"), split.alias("split"), *[label(F.col("slide_id"), g).alias(g) for g in GRANULARITIES])


def label(slide: Column, granularity: str) -> Column:
    return F.floor(slide / GRANULARITIES[granularity])


def _for_backbones(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    each = F.explode(F.array(*[F.struct(F.lit(b).alias("backbone"), F.slice("emb", 1, BACKBONES[b]).alias("emb")) for b in names]))
    return df.withColumn("_b", each).drop("emb").select("*", "_b.backbone", "_b.emb").drop("_b")


COND = ("backbone", "scenario")


def pooled(spark: SparkSession, sf_dir: str, backbones: tuple[str, ...] = ("B64",)) -> DataFrame:
    return pool(_for_backbones(patches(spark, sf_dir), backbones), ("backbone", "slide_id"))


def pairs(spark: SparkSession, sf_dir: str, backbones: tuple[str, ...] = ("B64",), scenarios: tuple[str, ...] = ("strict",), splits: tuple[str, ...] = ()) -> DataFrame:
    """``backbone, scenario, slide_id, report_id, s_g, s_p, slide_pos, report_pos`` with raw patches as banks."""
    texts = _for_backbones(reports(spark, sf_dir).filter(F.col("scenario").isin(*scenarios)), backbones).withColumn("emb", unit(F.col("emb")))
    every = F.explode(F.array(*map(F.lit, scenarios))).alias("scenario")
    whole = pooled(spark, sf_dir, backbones).select("backbone", "slide_id", F.col("mean_pool").alias("emb"))
    banks = _for_backbones(patches(spark, sf_dir), backbones).select("backbone", "slide_id", "emb")
    if splits:
        kept = slides(spark, sf_dir).filter(F.col("split").isin(*splits)).select("slide_id")
        texts, whole, banks = (x.join(kept, "slide_id", "left_semi") for x in (texts, whole, banks))
    texts = texts.select(*COND, F.col("slide_id").alias("report_id"), "emb")
    got = similarities(whole.select("*", every), banks.select("*", every), texts, SLIDES, SLIDES, COND)
    return got.withColumns({"slide_pos": F.col("slide_id"), "report_pos": F.col("report_id")})


def both_ways(spark: SparkSession, sf_dir: str, **kw) -> DataFrame:
    return directed(pairs(spark, sf_dir, **kw))


def reports_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports made of ``documents``; every third has a rewrite already."""
    d = read(spark, sf_dir, "documents")
    words = F.slice(F.filter(F.split("text", r"[\t-\r ]+"), lambda w: w != ""), 1, 3)
    done = F.when(F.col("doc_id") % 3 == 0, F.substring("text", 1, 30))
    return d.select(F.col("doc_id").alias("slide_id"), F.col("doc_id").cast("string").alias("case_id"), F.col("source").alias("project_id"), F.col("text").alias("slide_reports"), F.array_join(words, " ").alias("cancer_type_detailed"), F.col("lang").alias("site_of_resection_or_biopsy"), done.alias("slide_reports_no_diagnosis_strict"))


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh report is audited, every 21st as insufficient."""
    d = reports_text(spark, sf_dir).filter("slide_id % 7 = 0")
    out = F.col("slide_id") % 21 == 0
    return d.select("slide_id", "case_id", "project_id", F.col("slide_reports").alias("original_slide_reports"), out.alias("excluded_insufficient_source"), F.when(out, "").otherwise(F.concat(F.lit("Rewritten "), F.substring("slide_reports", 1, 40))).alias("rewritten_text"), (F.col("slide_id") % 14 == 0).alias("leakage_flag_after_retries"), F.lit(1).alias("attempts_used"))


def ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed ids: those of ``labels``, and some that no report has."""
    listed = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("slide_id"))
    return listed.union(listed.filter("slide_id % 10 = 0").select(F.col("slide_id") + 1_000_000_000))
