"""Jobs over files on disk: caches, benchmarks and report texts, from one configuration.

The configuration (YAML or JSON) has ``backbones`` (for each: ``image_embeddings_dir``, ``pool_cache_path``,
``prototypes_dir``, ``text_embeddings`` by scenario), ``cohort`` (``split_csv``, ``labels_csv``) and ``output_dir``.
"""

from __future__ import annotations

import json
from functools import reduce
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crossrank.operators import cohort, ranking, rewriting
from crossrank.operators.pooling import consistent_dimension, pool
from crossrank.operators.prototypes import DEFAULTS, Settings, build_banks
from crossrank.operators.similarity import directed, similarities
from crossrank.plans import experiments
from crossrank.sources import files

SCENARIOS = ("original", "strict", "diagnosis_only")
GRANULARITIES = ("OncotreeCode", "project_id")
COND = ("backbone", "scenario", "direction")
#: Reports that a task slot rewrites between two checkpoints.
CHECKPOINT_ROWS = 25


def load_config(path: str) -> dict:
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as f:
            return json.load(f)
    return files.read_config(path)


def build_pool_cache(spark: SparkSession, cfg: dict, backbone: str, overwrite: bool = False) -> None:
    """Pools all patch files of a backbone; an existing cache stays unless ``overwrite``."""
    bb = cfg["backbones"][backbone]
    patches = files.read_arrays(spark, bb["image_embeddings_dir"])
    consistent_dimension(patches)
    files.write_pool_cache(pool(patches), bb["pool_cache_path"], overwrite)


def build_prototypes(spark: SparkSession, cfg: dict, backbone: str, settings: Settings = DEFAULTS, npz: bool = False) -> None:
    """Adds the banks of slides that have none yet, as Parquet or (``npz``) as an archive for each slide."""
    bb = cfg["backbones"][backbone]
    patches = files.read_arrays(spark, bb["image_embeddings_dir"])
    banks = build_banks(files.missing_banks(spark, patches, bb["prototypes_dir"]), settings)
    (files.append_bank_archives if npz else files.append_banks)(banks, bb["prototypes_dir"])


def cases_in_file_order(spark: SparkSession, cfg: dict, splits: tuple[str, ...]) -> DataFrame:
    """``slide_id, case_id, split, gallery_pos``: the cases of some splits in the order of the split table."""
    t = files.read_table_in_order(spark, cfg["cohort"]["split_csv"])
    order = Window.partitionBy(F.lit(0)).orderBy("_file", "_row")  # a table of cases: a few columns of text
    return t.filter(F.col("split").isin(*splits)).withColumn("gallery_pos", (F.row_number().over(order) - 1).cast("long")).drop("_file", "_row")


def cases_by_name(cases: DataFrame) -> DataFrame:
    """``slide_id, gallery_pos`` in the order of the names."""
    order = Window.partitionBy(F.lit(0)).orderBy("slide_id")
    return cases.select("slide_id").distinct().withColumn("gallery_pos", (F.row_number().over(order) - 1).cast("long"))


def labels(spark: SparkSession, cfg: dict, cases: DataFrame, granularities: tuple[str, ...]) -> DataFrame:
    """``granularity, id, label`` of the cases; a case without a row in the label table fails the job."""
    found = cohort.lookup(cases.select("slide_id"), files.read_table(spark, cfg["cohort"]["labels_csv"]).select("slide_id", *granularities))
    each = F.explode(F.array(*[F.struct(F.lit(g).alias("granularity"), F.col(g).alias("label")) for g in granularities]))
    return found.select(F.col("slide_id").alias("id"), each.alias("_g")).select("_g.granularity", "id", "_g.label")


def pairs(spark: SparkSession, cfg: dict, backbones: list[str], scenarios: tuple[str, ...], cases: DataFrame, renormalise: bool = True, banks: bool = True) -> DataFrame:
    """Both directions of all pairs of the cases, for every backbone and scenario."""
    n = cases.count()
    out = []
    for b in backbones:  # backbones differ in their dimension, so each has a product of its own
        bb = cfg["backbones"][b]
        every = [F.lit(b).alias("backbone"), F.explode(F.array(*map(F.lit, scenarios))).alias("scenario")]
        pooled = files.read_pool_cache(spark, bb["pool_cache_path"], cases.select("slide_id"), renormalise).select(*every[:1], "slide_id", "emb", every[1])
        held = files.read_banks(spark, bb["prototypes_dir"]).join(cases.select("slide_id"), "slide_id", "left_semi") if banks else None
        held = held.select(*every[:1], "slide_id", "emb", every[1]) if banks else pooled.limit(0)
        texts = reduce(DataFrame.unionByName, [files.read_text_vectors(spark, bb["text_embeddings"][s]).select(F.lit(b).alias("backbone"), F.lit(s).alias("scenario"), F.col("slide_id").alias("report_id"), "emb") for s in scenarios])
        texts = texts.join(cases.select(F.col("slide_id").alias("report_id")), "report_id", "left_semi").select("backbone", "scenario", "report_id", "emb")
        out.append(similarities(pooled, held, texts, n, n, ("backbone", "scenario"), renormalise))
    got = reduce(DataFrame.unionByName, out)
    at = cases.select("slide_id", F.col("gallery_pos").alias("slide_pos"))
    got = got.join(at, "slide_id").join(at.withColumnsRenamed({"slide_id": "report_id", "slide_pos": "report_pos"}), "report_id")
    return directed(got)


def run_heldout(spark: SparkSession, cfg: dict, backbone: str, scenario: str = "strict", granularity: str = "OncotreeCode", split: str = "test", tie_break: str = "stable", n_tie_seeds: int = 50) -> DataFrame:
    cases = cases_in_file_order(spark, cfg, (split,))
    n = cases.count()
    orders = ranking.permutations(spark, n, n_tie_seeds) if tie_break == "neutral" else None
    got = experiments.held_out(pairs(spark, cfg, [backbone], (scenario,), cases), labels(spark, cfg, cases, (granularity,)), n, COND, orders)
    got = got.select(F.lit(tie_break).alias("tie_break"), "*")
    files.write_results(got, f"{cfg['output_dir']}/{files.result_name('heldout', backbone, scenario, granularity, split, tie_break)}")
    return got


def run_grid(spark: SparkSession, cfg: dict, backbones: list[str] | None = None) -> DataFrame:
    """Mean pooling against the fused score over train and test cases, in every condition."""
    cases = cases_by_name(cases_in_file_order(spark, cfg, ("train", "test")))
    got = experiments.method_grid(pairs(spark, cfg, backbones or list(cfg["backbones"]), SCENARIOS, cases), labels(spark, cfg, cases, GRANULARITIES), cases.count())
    files.write_results(got, f"{cfg['output_dir']}/{files.result_name('grid')}")
    return got


def run_stress_test(spark: SparkSession, cfg: dict, backbones: list[str] | None = None) -> DataFrame:
    """Mean pooling alone over all pooled cases; pooled vectors are taken as they are in the cache."""
    out = []
    for b in backbones or list(cfg["backbones"]):
        cases = cases_by_name(files.pool_table(spark, cfg["backbones"][b]["pool_cache_path"]).select("slide_id"))
        out.append(experiments.stress_test(pairs(spark, cfg, [b], SCENARIOS, cases, renormalise=False, banks=False), labels(spark, cfg, cases, GRANULARITIES), cases.count()))
    got = reduce(DataFrame.unionByName, out)
    files.write_results(got, f"{cfg['output_dir']}/{files.result_name('stress_test')}")
    return got


def run_score_ablation(spark: SparkSession, cfg: dict, backbone: str, scenario: str = "strict", split: str = "test", n_boot: int = 20_000, seed: int = 42, hashed: bool = False) -> DataFrame:
    """All score variants against the full score; draws from NumPy's stream unless ``hashed``."""
    cases = cases_in_file_order(spark, cfg, (split,))
    queries = experiments.ablation_queries(pairs(spark, cfg, [backbone], (scenario,), cases), labels(spark, cfg, cases, GRANULARITIES[:1]), cases.count(), COND)
    units = cases.select(F.col("slide_id").alias("query_id"), F.col("case_id").alias("unit"))
    got = experiments.score_ablation(queries, units, replicates=n_boot, seed=seed, hashed=hashed)
    files.write_results(got, f"{cfg['output_dir']}/{files.result_name('score_ablation', backbone, scenario, split)}")
    return got


def rewrite_reports(spark: SparkSession, csv: str, audit: str, rewriter: rewriting.Rewriter | str, out: str | None = None, ids: str | None = None, pilot: int = 0, seed: int = 0, attempts: int = 3, overwrite: bool = False) -> DataFrame:
    """Rewrites reports that are still to do, adds their audit records, and writes the table with all rewrites.

    Reports go in waves of ``CHECKPOINT_ROWS`` for each task slot; a wave's records are in the audit before the next
    begins, so a run that dies loses a wave at most, and the next run goes on behind it. Failures of the service are
    waited out. The table is made from the audit, and replaces the old one when it is whole. A pilot writes no table.
    Gives the audit of this run.
    """
    rewriter = rewriting.with_backoff(rewriting.load(rewriter) if isinstance(rewriter, str) else rewriter)
    reports = files.read_reports(spark, csv)
    for column in ("case_id", "project_id", cohort.REWRITE):
        reports = reports if column in reports.columns else reports.withColumn(column, F.lit(None).cast("string"))
    todo = cohort.universe(reports, files.read_table(spark, ids) if ids else None)
    todo = cohort.stratified_pilot(todo, pilot, seed) if pilot else todo
    schema = rewriting.AUDIT.format("string")
    files.recover(spark, audit)
    old = files.read_audit(spark, audit, schema) if files.exists(spark, audit) else spark.createDataFrame([], schema)
    # What is to do is fixed before the first record is added, and lies in a folder for each wave.
    slots = spark.sparkContext.defaultParallelism
    chosen = cohort.to_process(todo, old, overwrite)
    waves = max(1, -(-chosen.count() // (CHECKPOINT_ROWS * slots)))
    run = f"{files.scratch_dir(spark)}/rewrites-{uuid4().hex}"
    chosen.withColumn("wave", F.pmod(F.xxhash64("slide_id"), F.lit(waves))).write.partitionBy("wave").parquet(run)
    fixed = spark.read.schema(chosen.schema.add("wave", "long")).parquet(run)
    if overwrite and files.exists(spark, audit):
        known = cohort.kept_audit(old, todo, overwrite)
        files.replace(spark, audit, known.write.json)
    for wave in range(waves):
        files.write_audit(rewriting.rewrite(fixed.filter(F.col("wave") == wave).drop("wave").repartition(slots), rewriter, attempts), audit)
    every = files.read_audit(spark, audit, schema)
    if out and not pilot:
        files.write_reports(cohort.backfill(reports.withColumn(cohort.REWRITE, F.lit(None).cast("string")) if overwrite else reports, every), out)
    return every.join(fixed.select("slide_id").distinct(), "slide_id", "left_semi")


def diagnosis_only(spark: SparkSession, csv: str, out: str, ids: str | None = None) -> DataFrame:
    got = cohort.diagnosis_only(files.read_reports(spark, csv), files.read_table(spark, ids) if ids else None)
    files.write_reports(got, out)
    return got
