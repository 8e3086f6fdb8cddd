"""Command line: ``python -m crossrank JOB --config FILE ...``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from crossrank.plans import jobs


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="crossrank", description="Re-ranking jobs over files on disk.")
    sub = p.add_subparsers(dest="job", required=True)

    def job(name: str, *options, config: bool = True) -> None:
        s = sub.add_parser(name)
        if config:
            s.add_argument("--config", required=True)
        for flags, kw in options:
            s.add_argument(*flags, **kw)

    backbone = (("--backbone",), {"required": True})
    several = (("--backbones",), {"nargs": "+", "default": None})
    scenario = (("--scenario",), {"default": "strict", "choices": jobs.SCENARIOS})
    split = (("--split",), {"default": "test"})
    job("build-pool-cache", backbone, (("--overwrite",), {"action": "store_true"}))
    job("build-prototypes", backbone, (("--npz",), {"action": "store_true", "help": "an archive for each slide"}))
    job("stress-test", several)
    job("grid", several)
    job("heldout", backbone, scenario, split, (("--granularity",), {"default": "OncotreeCode", "choices": jobs.GRANULARITIES}), (("--tie-break",), {"default": "stable", "choices": ("stable", "neutral")}), (("--n-tie-seeds",), {"type": int, "default": 50}))
    job("score-ablation", backbone, scenario, split, (("--n-boot",), {"type": int, "default": 20_000}), (("--seed",), {"type": int, "default": 42}))
    job("rewrite-reports", (("--csv",), {"required": True}), (("--audit",), {"required": True}), (("--rewriter",), {"required": True, "help": "module:function that takes instructions and a payload and gives the reply's JSON"}), (("--out",), {}), (("--ids",), {}), (("--pilot",), {"type": int, "default": 0}), (("--seed",), {"type": int, "default": 0}), (("--max-attempts",), {"type": int, "default": 3, "dest": "attempts"}), (("--overwrite",), {"action": "store_true"}), config=False)
    job("diagnosis-only", (("--csv",), {"required": True}), (("--out",), {"required": True}), (("--ids",), {}), config=False)
    return p


JOBS = {
    "build-pool-cache": jobs.build_pool_cache,
    "build-prototypes": jobs.build_prototypes,
    "stress-test": jobs.run_stress_test,
    "grid": jobs.run_grid,
    "heldout": jobs.run_heldout,
    "score-ablation": jobs.run_score_ablation,
    "rewrite-reports": jobs.rewrite_reports,
    "diagnosis-only": jobs.diagnosis_only,
}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = vars(parser().parse_args(argv))
    run, config = JOBS[args.pop("job")], args.pop("config", None)
    spark = spark or SparkSession.builder.appName("crossrank").getOrCreate()
    got = run(spark, *([jobs.load_config(config)] if config else []), **args)
    if got is not None:
        got.show(60, truncate=False)


if __name__ == "__main__":
    main()
