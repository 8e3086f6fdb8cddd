"""Readers and writers: arrays, caches, tables of cases, reports, audit records."""

from __future__ import annotations

import os
import re
import tempfile
from collections.abc import Callable, Iterator
from io import BytesIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossrank.functions.vectors import as_doubles, unit

#: Texts that stand for a missing value in comma-separated files.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see; only a local session may do without ``spark.checkpoint.dir``."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return where or "file://" + os.path.join(tempfile.gettempdir(), "crossrank-scratch")


def _store(spark: SparkSession, path: str):
    """The path and its store, whichever Spark can reach."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, store = _store(spark, path)
    return store.exists(p)


def recover(spark: SparkSession, path: str) -> None:
    """Puts back what a replacement that was cut short had moved aside."""
    p, store = _store(spark, path)
    old = p.suffix("._old")
    if store.exists(old) and not store.exists(p):
        store.rename(old, p)


def replace(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """Replaces a file or folder by what ``write`` makes beside it; until that is whole the old one stays."""
    recover(spark, path)
    p, store = _store(spark, path)
    new, old = p.suffix("._new"), p.suffix("._old")
    store.delete(new, True)
    write(new.toString())
    store.delete(old, True)
    if store.exists(p):
        store.rename(p, old)
    store.rename(new, p)
    store.delete(old, True)


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """One file in any store that Spark can reach."""
    p, store = _store(spark, path)
    out = store.create(p, True)
    try:
        out.write(data)
    finally:
        out.close()


def read_arrays(spark: SparkSession, folder: str) -> DataFrame:
    """``slide_id, patch_idx, emb`` of the ``.npy`` files of a folder: a row of each array's row, by file name."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(folder)
    named = raw.select(F.regexp_extract("path", r"([^/]+)\.npy$", 1).alias("slide_id"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = np.load(BytesIO(content), allow_pickle=False).astype(np.float32)
                x = x.reshape(1, -1) if x.ndim == 1 else x
                if x.ndim != 2:
                    raise ValueError(f"{name}: expected a matrix, got {x.ndim} dimensions")
                for s in range(0, len(x), 4096):
                    part = x[s : s + 4096]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(np.arange(s, s + len(part))), pa.array(list(part), pa.list_(pa.float32()))], ["slide_id", "patch_idx", "emb"])

    return named.mapInArrow(run, "slide_id string, patch_idx long, emb array<float>")


def write_arrays(rows: DataFrame, folder: str) -> None:
    """A ``.npy`` matrix of floats for each slide, from ``slide_id, patch_idx, emb``.

    Executors make them; the driver writes one after another, as each is a file of its own.
    """

    def one(group: pa.Table) -> pa.Table:
        group, data = group.sort_by("patch_idx"), BytesIO()
        np.save(data, np.array(group.column("emb").to_pylist(), np.float32))
        return pa.table({"slide_id": [str(group.column("slide_id")[0].as_py())], "content": pa.array([data.getvalue()], pa.binary())})

    spark = rows.sparkSession
    for r in rows.select("slide_id", "patch_idx", "emb").groupBy("slide_id").applyInArrow(one, "slide_id string, content binary").toLocalIterator():
        write_bytes(spark, f"{folder}/{r.slide_id}.npy", bytes(r.content))


def read_text_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """``slide_id, emb``: one unit vector of doubles for each file."""
    return read_arrays(spark, folder).filter("patch_idx = 0").select("slide_id", unit(as_doubles(F.col("emb"))).alias("emb"))


def read_pool_npz(spark: SparkSession, path: str, allow_pickle: bool = False) -> DataFrame:
    """``slide_id, mean_pool, max_pool`` of one ``.npz`` pool cache; ids kept as objects need ``allow_pickle``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0).to_pylist():
                z = np.load(BytesIO(content), allow_pickle=allow_pickle)
                ids, mean, most = z["case_ids"], z["mean_pool"], z["max_pool"]
                for s in range(0, len(ids), 4096):
                    kind = pa.list_(pa.float32())
                    yield pa.RecordBatch.from_arrays([pa.array([str(i) for i in ids[s : s + 4096]]), pa.array(list(mean[s : s + 4096].astype(np.float32)), kind), pa.array(list(most[s : s + 4096].astype(np.float32)), kind)], ["slide_id", "mean_pool", "max_pool"])

    raw = spark.read.format("binaryFile").load(path).select("content")
    return raw.mapInArrow(run, "slide_id string, mean_pool array<float>, max_pool array<float>")


def read_bank_npz(spark: SparkSession, folder: str) -> DataFrame:
    """Banks of a folder of ``<slide>_prototype.npz`` files: a row for each prototype, with the bank's figures."""
    figures = ("K_star", "coverage", "support", "utility", "q_proto", "n_patches")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                z = np.load(BytesIO(content), allow_pickle=False)
                x = z["prototypes"].astype(float)
                one = [float(np.ravel(z[f])[0]) for f in figures]
                rest = [pa.array([v if v == v else None] * len(x), pa.float64()) for v in one]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(x)), pa.array(range(len(x)), pa.int32()), pa.array(list(x), pa.list_(pa.float64())), *rest], ["slide_id", "h", "emb", *(f.lower() for f in figures)])

    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*_prototype.npz").load(folder)
    named = raw.select(F.regexp_extract("path", r"([^/]+)_prototype\.npz$", 1).alias("slide_id"), "content")
    return named.mapInArrow(run, "slide_id string, h int, emb array<double>, " + ", ".join(f"{f.lower()} double" for f in figures))


def pool_table(spark: SparkSession, path: str) -> DataFrame:
    """``slide_id, mean_pool, max_pool`` of a cache in either format."""
    return read_pool_npz(spark, path) if path.endswith(".npz") else spark.read.parquet(path)


def write_pool_cache(pooled: DataFrame, path: str, overwrite: bool = False) -> None:
    """Pooled vectors as floats; an existing cache stays unless it is to be overwritten.

    A path that ends in ``.npz`` gets one archive, in the order of the ids, which the driver writes and so must hold;
    all others get Parquet.
    """
    spark = pooled.sparkSession
    recover(spark, path)
    if exists(spark, path) and not overwrite:
        return
    out = pooled.select("slide_id", F.col("mean_pool").cast("array<float>").alias("mean_pool"), F.col("max_pool").cast("array<float>").alias("max_pool"))
    if not path.endswith(".npz"):
        replace(spark, path, out.write.parquet)
        return
    got = out.orderBy("slide_id").toArrow()
    vectors = {c: np.array(got.column(c).to_pylist(), np.float32) for c in ("mean_pool", "max_pool")}
    data = BytesIO()
    np.savez(data, case_ids=np.array([str(i) for i in got.column("slide_id").to_pylist()]), **vectors)
    replace(spark, path, lambda to: write_bytes(spark, to, data.getvalue()))


def read_pool_cache(spark: SparkSession, path: str, cases: DataFrame, renormalise: bool = True) -> DataFrame:
    """Mean-pooled vectors of the given cases as doubles; columns that are not asked for are not read."""
    cache = pool_table(spark, path).select("slide_id", as_doubles(F.col("mean_pool")).alias("emb")).join(cases, "slide_id")
    return cache.withColumn("emb", unit(F.col("emb"))) if renormalise else cache


def _bank_files(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*_prototype.npz").load(path)
    return raw.select(F.regexp_extract("path", r"([^/]+)_prototype\.npz$", 1).alias("slide_id"))


def archived_banks(spark: SparkSession, path: str) -> bool:
    """Whether a folder has a bank in an archive of its own for each slide, rather than Parquet."""
    p, store = _store(spark, path + "/*_prototype.npz")
    found = store.globStatus(p)
    return found is not None and len(found) > 0


def missing_banks(spark: SparkSession, patches: DataFrame, path: str) -> DataFrame:
    """Patches of slides that have no bank at ``path`` yet."""
    if not exists(spark, path):
        return patches
    known = _bank_files(spark, path) if archived_banks(spark, path) else spark.read.parquet(path)
    return patches.join(known.select("slide_id").distinct(), "slide_id", "left_anti")


def append_banks(banks: DataFrame, path: str) -> None:
    banks.write.mode("append").parquet(path)


def append_bank_archives(banks: DataFrame, path: str) -> None:
    """An archive ``<slide>_prototype.npz`` for each slide. Executors make them; the driver writes one after another."""
    figures = {"k_star": ("K_star", np.int32), "coverage": ("coverage", np.float32), "support": ("support", np.float32), "utility": ("utility", np.float32), "q_proto": ("q_proto", np.float32), "n_patches": ("n_patches", np.int32)}

    def archive(group: pa.Table) -> pa.Table:
        group = group.sort_by("h")
        first = {k: group.column(k)[0].as_py() for k in figures}
        data = BytesIO()
        np.savez_compressed(data, prototypes=np.array(group.column("emb").to_pylist(), np.float32), **{to: np.array([np.nan if first[k] is None else first[k]], t) for k, (to, t) in figures.items()})
        return pa.table({"slide_id": [str(group.column("slide_id")[0].as_py())], "content": pa.array([data.getvalue()], pa.binary())})

    spark = banks.sparkSession
    for r in banks.groupBy("slide_id").applyInArrow(archive, "slide_id string, content binary").toLocalIterator():
        replace(spark, f"{path}/{r.slide_id}_prototype.npz", lambda to, data=bytes(r.content): write_bytes(spark, to, data))


def read_banks(spark: SparkSession, path: str) -> DataFrame:
    """``slide_id, h, emb`` with unit vectors of doubles, from either format."""
    held = read_bank_npz(spark, path) if archived_banks(spark, path) else spark.read.parquet(path)
    return held.select("slide_id", "h", unit(as_doubles(F.col("emb"))).alias("emb"))


def _known(df: DataFrame) -> DataFrame:
    return df.select(*[F.when(F.col(f"`{c}`").isin(*MISSING), None).otherwise(F.col(f"`{c}`")).alias(c) for c in df.columns])


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A comma-separated table of cases (splits, labels, ids); all columns are text."""
    return _known(spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"'))


def read_table_in_order(spark: SparkSession, path: str) -> DataFrame:
    """``read_table`` with ``_file`` and ``_row``, by which rows sort as they stand in the files, in the order of names."""
    raw = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')  # a file with such rows is not split
    placed = raw.select("*", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_row"))
    return _known(placed.select(*raw.columns, "_file", F.col("_row").cast("string").alias("_row"))).withColumn("_row", F.col("_row").cast("long"))


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """The semicolon-separated master table of reports, without unnamed columns; texts may hold line ends."""
    df = spark.read.csv(path, header=True, sep=";", multiLine=True, quote='"', escape='"')
    return _known(df.drop(*[c for c in df.columns if re.match(r"Unnamed|_c\d+$|$", c)]))


#: Values as they are: Spark's writer would trim them.
WRITTEN = {"header": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_reports(df: DataFrame, path: str) -> None:
    replace(df.sparkSession, path, lambda to: df.write.csv(to, sep=";", **WRITTEN))


def write_results(df: DataFrame, path: str) -> None:
    """A result table as one file (results have a row for each condition)."""
    replace(df.sparkSession, path, lambda to: df.coalesce(1).write.csv(to, **WRITTEN))


def result_name(kind: str, *parts: str) -> str:
    return "_".join((kind, *parts)) + ".csv"


def write_audit(audit: DataFrame, path: str) -> None:
    """Audit records, one JSON object a line; the committer shows whole files only."""
    audit.write.mode("append").json(path)


def read_audit(spark: SparkSession, path: str, schema: str, listed: bool = False) -> DataFrame:
    """Audit records; ``listed``: from one JSON list."""
    return spark.read.schema(schema).json(path, multiLine=listed)


def read_config(path: str) -> dict:
    """A YAML file of paths and cohorts."""
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f)
