"""The nearest products of every product, by a grid that doubles its cells.

Unknown values cost nothing, so products are compared in the dimensions that both sides know. Products of equal
specifications are one point, for sources as for candidates. In each round a source meets the candidates of the 3 x 3 cells
around it; whatever it didn't meet is farther away than a cell is wide. A source is done when its worst kept score is no
more than that; the others go on with cells of twice the width. So a product never meets all others unless it needs to.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import work_folder
from .ranking import DIFF_RANGE, MISMATCH, RG_RANGE

CLASSES = list(MISMATCH)
#: Candidates of a cell in the first round, about.
PER_CELL = 8
#: Distances that agree in so many decimals are ties.
DIGITS = 9


def _staged(df: DataFrame, name: str) -> DataFrame:
    path = work_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _points(df: DataFrame) -> DataFrame:
    """df with x and y (scaled specifications) and known (bits: x, y)."""
    x, y = (F.col(c).cast("double") / F.lit(span) for c, span in (("rg", RG_RANGE), ("differential", DIFF_RANGE)))
    known = x.isNotNull().cast("int") * 2 + y.isNotNull().cast("int")
    return df.select("product", x.alias("x"), y.alias("y"), known.alias("known"), *CLASSES)


def _seen_through(df: DataFrame, other: str, own: str) -> DataFrame:
    """df once for each set of dimensions that other sides may know, with px and py in the dimensions both know."""
    d = df.withColumn(other, F.explode(F.array(*map(F.lit, range(4))))).withColumn("both", F.col(own).bitwiseAND(F.col(other)))
    keep = lambda c, bit: F.when(F.col("both").bitwiseAND(F.lit(bit)) > 0, F.col(c)).otherwise(F.lit(0.0))
    return d.withColumn("px", keep("x", 2)).withColumn("py", keep("y", 1))


def _penalty():
    return sum((F.when(F.col(f"s_{k}") != F.col(f"c_{k}"), cost).otherwise(0.0) for k, cost in MISMATCH.items()), F.lit(0.0))


def _best(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("score", "candidate")
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _cell(c: str, width: float):
    return F.floor(F.col(c) / F.lit(width)).cast("long")


def nearest(sources: DataFrame, candidates: DataFrame, k: int = 6) -> DataFrame:
    """(product, candidate, score, rank): the k candidates of lowest distance of each source, itself left out, ties by id.

    Both sides: product, rg, differential and the columns of MISMATCH. If there are fewer than k candidates, all.
    """
    s, c = _points(sources), _points(candidates)
    spec = ["x", "y", "known", *CLASSES]
    # the first k + 1 products of equal specifications stand for all of them; one of these may be the source itself
    w = Window.partitionBy(*spec).orderBy("product")
    few = c.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= k + 1).drop("n")
    held = _seen_through(few, "source_known", "known").select("source_known", "both", "px", "py", *(F.col(x).alias(f"c_{x}") for x in CLASSES), F.col("product").alias("candidate"))
    held = _staged(held, "candidates")
    points = _staged(s.select(*spec).distinct().withColumn("point", F.xxhash64(*spec)).select("point", *spec), "sources")
    box = held.agg(*(f(p).alias(f"{n}{p}") for p in ("px", "py") for n, f in (("a", F.min), ("z", F.max))), F.count("*").alias("n")).first()
    if not box.n:
        return s.select("product", F.lit(None).cast("long").alias("candidate"), F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    ends = points.agg(*(f(p) for p in ("x", "y") for f in (F.min, F.max))).first()
    span = max(max(v for v in (box.zpx, ends[1], box.zpy, ends[3]) if v is not None) - min(v for v in (box.apx, ends[0], box.apy, ends[2]) if v is not None), 0.0)
    cell = span / max(1.0, math.sqrt(box.n / PER_CELL)) or 1.0
    open_points, done = points, None
    around = F.array(*(F.struct(F.lit(a).alias("i"), F.lit(b).alias("j")) for a in (-1, 0, 1) for b in (-1, 0, 1)))
    while True:
        asks = _seen_through(open_points.withColumnRenamed("known", "source_known"), "known", "source_known")
        asks = asks.select("point", "source_known", "both", "px", "py", *(F.col(x).alias(f"s_{x}") for x in CLASSES)).distinct()
        asks = asks.withColumn("go", F.explode(around)).select("*", (_cell("px", cell) + F.col("go.i")).alias("i"), (_cell("py", cell) + F.col("go.j")).alias("j"))
        there = held.withColumnsRenamed({"px": "qx", "py": "qy"}).withColumn("i", _cell("qx", cell)).withColumn("j", _cell("qy", cell))
        met = asks.join(there, ["source_known", "both", "i", "j"])
        score = F.sqrt(F.pow(F.col("px") - F.col("qx"), F.lit(2.0)) + F.pow(F.col("py") - F.col("qy"), F.lit(2.0))) + _penalty()
        found = _staged(_best(met.select("point", "candidate", F.round(score, DIGITS).alias("score")), ["point"], k + 1).select("point", "candidate", "score"), "met")
        last = cell > span
        worst = found.groupBy("point").agg(F.count("*").alias("n"), F.max("score").alias("worst")).filter(F.lit(last) | (F.col("n") > k) & (F.col("worst") + 10.0**-DIGITS < cell)).select("point")
        now = found.join(worst, "point", "left_semi")
        done = now if done is None else done.union(now)
        if last:
            break
        open_points = _staged(open_points.join(worst, "point", "left_anti"), "open")
        if open_points.isEmpty():
            break
        cell *= 2
    own = s.withColumn("point", F.xxhash64(*spec)).select("product", "point")
    pairs = own.join(done, "point").filter("product <> candidate")
    return _best(pairs.select("product", "candidate", "score"), ["product"], k).select("product", "candidate", "score", "rank")

