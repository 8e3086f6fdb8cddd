"""Which reports to process: universe, missing ids, pilot sample, backfill and resume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crossrank.functions.text import useful
from crossrank.operators.statistics import md5_number

SOURCE, REWRITE = "slide_reports", "slide_reports_no_diagnosis_strict"


def universe(reports: DataFrame, ids: DataFrame | None) -> DataFrame:
    """Reports whose id is listed; all of them without a list."""
    return reports if ids is None else reports.join(ids.select("slide_id").distinct(), "slide_id", "left_semi")


def missing(reports: DataFrame, ids: DataFrame) -> DataFrame:
    """Listed ids that have no report."""
    return ids.select("slide_id").distinct().join(reports.select("slide_id"), "slide_id", "left_anti")


def lookup(rows: DataFrame, table: DataFrame, on: str = "slide_id") -> DataFrame:
    """Rows with the table's columns; raises at run time on a row whose key is not in the table."""
    found = rows.join(table.withColumn("_found", F.lit(True)), on, "left")
    sure = F.when(F.col("_found"), F.col(on)).otherwise(F.raise_error(F.concat(F.lit(f"no {on} "), F.col(on).cast("string"))))
    return found.withColumn(on, sure).drop("_found")


def with_source(reports: DataFrame) -> DataFrame:
    return reports.filter(F.col(SOURCE).isNotNull() & (F.trim(F.regexp_replace(SOURCE, r"\s+", " ")) != ""))


def diagnosis_only(reports: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """``slide_id, diagnosis_only_text`` of the listed reports that have a diagnosis."""
    return universe(reports, ids).filter("cancer_type_detailed is not null").select("slide_id", F.col("cancer_type_detailed").alias("diagnosis_only_text"))


def stratified_pilot(reports: DataFrame, n: int, seed: int = 0, draw: Column | None = None) -> DataFrame:
    """About ``n`` reports in proportion to their project, at least one of each, never more than ``n``.

    Rows of a project are drawn in the order of a hash of seed and id, which any engine can repeat. Rows without a
    project are in no group. Shares of the projects come from counts, and ranking needs ids alone.
    """
    draw = md5_number(F.lit(seed), F.col("slide_id")) if draw is None else draw
    total = reports.count()
    n = min(n, total)
    if not n:
        return reports.limit(0)
    sizes = reports.filter("project_id is not null").groupBy("project_id").agg(F.count("*").alias("_size"))
    ids = reports.filter("project_id is not null").select("slide_id", "project_id", draw.alias("_draw")).join(sizes, "project_id")
    ids = ids.withColumn("_k", F.row_number().over(Window.partitionBy("project_id").orderBy("_draw", "slide_id")))
    ids = ids.filter(F.col("_k") <= F.greatest(F.lit(1), F.bround(F.col("_size") * F.lit(n / total)))).orderBy("_draw", "slide_id").limit(n)
    return reports.join(ids.select("slide_id"), "slide_id", "left_semi")


def backfill(reports: DataFrame, audit: DataFrame) -> DataFrame:
    """Reports with the audited rewrite where they have no useful one and the source was not insufficient."""
    known = audit.filter("not excluded_insufficient_source").select("slide_id", F.col("rewritten_text").alias("_text"), F.lit(True).alias("_known"))
    fill = F.col("_known") & ~F.coalesce(useful(F.col(REWRITE)), F.lit(False))
    return reports.join(known, "slide_id", "left").withColumn(REWRITE, F.when(fill, F.col("_text")).otherwise(F.col(REWRITE))).select(*reports.columns)


def to_process(reports: DataFrame, audit: DataFrame, overwrite: bool = False) -> DataFrame:
    """Reports still to rewrite: neither a useful rewrite nor an audit record; all of them with ``overwrite``."""
    todo = with_source(reports)
    if overwrite:
        return todo
    return todo.filter(~F.coalesce(useful(F.col(REWRITE)), F.lit(False))).join(audit.select("slide_id"), "slide_id", "left_anti")


def kept_audit(audit: DataFrame, reports: DataFrame, overwrite: bool = False) -> DataFrame:
    """Audit records that stay: with ``overwrite``, those of reports that are not processed again."""
    return audit.join(with_source(reports).select("slide_id"), "slide_id", "left_anti") if overwrite else audit


def review(audit: DataFrame, reports: DataFrame) -> DataFrame:
    """What a reviewer of a pilot sees, for the reports of the pilot."""
    shown = audit.join(reports.select("slide_id"), "slide_id", "left_semi")
    return shown.select("slide_id", "project_id", F.col("original_slide_reports").alias(SOURCE), F.col("rewritten_text").alias(REWRITE), "excluded_insufficient_source", "leakage_flag_after_retries", "attempts_used")


def run_counts(audit: DataFrame) -> DataFrame:
    """Records, exclusions, and rewrites that may still leak."""
    return audit.agg(F.count("*").alias("n_rows"), F.count_if("excluded_insufficient_source").alias("n_excluded"), F.count_if(F.col("leakage_flag_after_retries") & ~F.col("excluded_insufficient_source")).alias("n_leaked"))
