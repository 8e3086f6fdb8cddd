"""Where a report's best prototype lies on a slide: assignment, stride, tissue box, crop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crossrank.functions.vectors import dot

#: Grey level from which a pixel is background, least tissue share of a row or column, crop margin.
BACKGROUND, TISSUE_SHARE, MARGIN = 235, 0.003, 0.015


def assign(patches: DataFrame, bank: DataFrame) -> DataFrame:
    """``slide_id, patch_idx, h, sim``: the prototype nearest to each patch, the first among equals."""
    both = patches.select("slide_id", "patch_idx", F.col("emb").alias("_x")).join(bank.select("slide_id", "h", F.col("emb").alias("_p")), "slide_id")
    order = Window.partitionBy("slide_id", "patch_idx").orderBy(F.desc("sim"), "h")
    return both.select("slide_id", "patch_idx", "h", dot(F.col("_x"), F.col("_p")).alias("sim")).withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def best_prototype(bank: DataFrame, report: DataFrame) -> DataFrame:
    """``slide_id, report_id, h, sim``: the prototype of each slide nearest to each report."""
    order = Window.partitionBy("slide_id", "report_id").orderBy(F.desc("sim"), "h")
    both = bank.select("slide_id", "h", F.col("emb").alias("_p")).join(report.select("slide_id", "report_id", F.col("emb").alias("_t")), "slide_id")
    return both.select("slide_id", "report_id", "h", dot(F.col("_p"), F.col("_t")).alias("sim")).withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def counts(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("slide_id", "h").agg(F.count("*").alias("n_patches"))


def stride(coords: DataFrame, by: tuple[str, ...] = ("slide_id",), x: str = "x") -> DataFrame:
    """The median step between distinct coordinates of a slide, truncated."""
    step = F.col(x) - F.lag(x).over(Window.partitionBy(*by).orderBy(x))
    return coords.select(*by, x).distinct().withColumn("_d", step).filter("_d > 0").groupBy(*by).agg(F.percentile("_d", 0.5).cast("int").alias("stride"))


def slide_metadata(description: Column) -> Column:
    """Magnification and micrometres a pixel from a slide file's description (``key=value`` parts between bars)."""
    parts = F.transform(F.split(description, r"\|"), lambda p: F.split(p, "="))
    value = lambda name: F.try_element_at(F.transform(F.filter(parts, lambda p: F.trim(p[0]).startswith(name)), lambda p: F.trim(p[1]).cast("double")), F.lit(1))
    return F.struct(value("AppMag").alias("app_mag"), value("MPP").alias("mpp"))


def footprint(step: Column, mpp: Column, app_mag: Column) -> Column:
    """A patch's side in micrometres, and in pixels at magnification 20."""
    um = step * mpp
    return F.struct(um.alias("patch_um"), (um / (mpp * app_mag / 20.0)).alias("px_20x"))


def tissue_span(pixels: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``r0, r1, c0, c1`` of the rows and columns with tissue, from ``y, x, r, g, b``; null where there is none."""
    dark = ((F.col("r") + F.col("g") + F.col("b")) / 3.0 < BACKGROUND).cast("int")
    marked = pixels.select(*by, "y", "x", dark.alias("_t"))

    def span(axis: str, a: str, b: str) -> DataFrame:
        kept = F.when(F.col("_f") > TISSUE_SHARE, F.col(axis))
        return marked.groupBy(*by, axis).agg(F.avg("_t").alias("_f")).groupBy(*by).agg(F.min(kept).alias(a), F.max(kept).alias(b))

    rows, cols = span("y", "r0", "r1"), span("x", "c0", "c1")
    return rows.join(cols, list(by)) if by else rows.crossJoin(cols)  # one row each


def tissue_box(pixels: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """As ``tissue_span``, but raises where there is none."""
    need = lambda c: F.when(F.col(c).isNotNull(), F.col(c)).otherwise(F.raise_error(F.lit("no tissue detected")))
    return tissue_span(pixels, by).select(*by, *[need(c).alias(c) for c in ("r0", "r1", "c0", "c1")])


def crop(box: DataFrame, height: Column, width: Column) -> DataFrame:
    """The box widened by the margin and kept inside the image."""
    margin = F.floor(F.greatest(F.col("r1") - F.col("r0"), F.col("c1") - F.col("c0")) * MARGIN)
    return box.withColumn("_m", margin).withColumns({"r0": F.greatest(F.lit(0), F.col("r0") - F.col("_m")), "r1": F.least(height - 1, F.col("r1") + F.col("_m")), "c0": F.greatest(F.lit(0), F.col("c0") - F.col("_m")), "c1": F.least(width - 1, F.col("c1") + F.col("_m"))}).drop("_m")


def to_crop(x: Column, y: Column, scale_x: Column, scale_y: Column, c0: Column, r0: Column) -> tuple[Column, Column]:
    """Level-0 coordinates in the pixels of a crop."""
    return x / scale_x - c0, y / scale_y - r0


def check_inside(points: DataFrame, width: Column, height: Column, patch_w: Column, patch_h: Column) -> DataFrame:
    """One row: how many points lie outside the crop (a patch's width of slack), and how many there are."""
    inside = F.col("px").between(-1, width + patch_w) & F.col("py").between(-1, height + patch_h)
    return points.agg(F.count_if(~inside).alias("n_outside"), F.count("*").alias("n_points"))
