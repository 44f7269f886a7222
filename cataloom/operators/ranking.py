"""Popularity, reference SKUs, specification similarity and the oil and motion estimate."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .inventory import DAY, seconds

HALF_LIFE_DAYS = 180.0
# Fixed values of the specification distance.
RG_RANGE, DIFF_RANGE = 0.35, 0.06
MISMATCH = {"core_type": 0.5, "cover_type": 0.2, "cover_material": 0.2}
# Fixed values of the oil and motion estimate.
OIL_BASE = {"polyester_plastic": 2, "urethane": 6, "reactive_resin": 10}
OIL_DEFAULT, OIL_RANGE, PARTICLE_OIL = 8.5, (1, 16), 2
OIL_BY_TYPE = {"pearl": -3, "hybrid": 0, "solid": 0}
MOTION_BASE = {"symmetric": 4, "asymmetric": 8}
MOTION_DEFAULT, MOTION_RANGE = 6, (1, 18)
MOTION_BY_TYPE = {"pearl": 2, "solid": 1, "hybrid": 0}
DIFF_MIDPOINT, DIFF_SCALE, DIFF_WEIGHT = 0.02, 0.045, 8


def popularity(videos: DataFrame, as_of: datetime) -> DataFrame:
    """(product, popularity): mean decayed views of approved videos, growing with the logarithm of their number.

    A video without published_at ages from created_at, if videos has that.
    """
    since = F.coalesce("published_at", "created_at") if "created_at" in videos.columns else F.col("published_at")
    age = (F.lit(as_of).cast("timestamp").cast("double") - seconds(since)) / DAY
    decayed = F.col("view_count") * F.pow(F.lit(2.0), -age / HALF_LIFE_DAYS)
    own = videos.filter("review = 'approved' and view_count is not null")
    return own.groupBy("product").agg((F.avg(decayed) * F.log1p(F.count("*").cast("double"))).alias("popularity"))


def with_popularity(products: DataFrame, videos: DataFrame, as_of: datetime) -> DataFrame:
    j = products.join(popularity(videos, as_of), "product", "left")
    return j.withColumn("popularity", F.coalesce("popularity", F.lit(0.0)))


def reference_sku(skus: DataFrame, target: int = 15) -> DataFrame:
    """The SKU of each product that stands for it: of the target weight, else the nearest, of two the heavier."""
    w = F.col("weight_lbs")
    best = F.min_by(F.struct("sku", "weight_lbs"), F.struct(F.abs(w - target), -w, "sku"))
    return skus.groupBy("product").agg(best.alias("x")).select("product", "x.*")


def training_sku(skus: DataFrame, target: int = 15) -> DataFrame:
    """The SKU of each product to learn from: of the target weight if its differential is known, else the heaviest with a known one."""
    place = F.struct((F.col("weight_lbs") == target).alias("a"), F.col("weight_lbs").alias("b"), F.col("sku").alias("c"))
    best = F.max_by(F.struct("sku", "weight_lbs", "differential"), place)
    return skus.filter("differential IS NOT NULL").groupBy("product").agg(best.alias("x")).select("product", "x.*")


def distance(a: str, b: str) -> Column:
    """Specification distance of the columns prefixed a and b; unknown values cost nothing."""

    def square(name: str, span: float) -> Column:
        return F.coalesce(F.pow((F.col(a + name) - F.col(b + name)) / span, F.lit(2.0)), F.lit(0.0))

    def penalty(name: str, cost: float) -> Column:
        return F.when(F.col(a + name) != F.col(b + name), cost).otherwise(0.0)

    total = F.sqrt(square("rg", RG_RANGE) + square("differential", DIFF_RANGE))
    return reduce(lambda x, y: x + y, [penalty(k, v) for k, v in MISMATCH.items()], total)


def similar(specs: DataFrame, product: int, k: int = 6) -> DataFrame:
    """(product, score) of the k products nearest to one. The one source row is sent to every task."""
    source = specs.filter(F.col("product") == product).limit(1).select(*[F.col(c).alias(f"s_{c}") for c in specs.columns])
    others = specs.filter(F.col("product") != product).select(*[F.col(c).alias(f"c_{c}") for c in specs.columns]).withColumn("one", F.lit(1))
    j = others.join(F.broadcast(source.withColumn("one", F.lit(1))), "one")
    return j.select(F.col("c_product").alias("product"), F.round(distance("s_", "c_"), 9).alias("score")).orderBy("score", "product").limit(k)


def _lookup(c: str, values: dict[str, float], default: float) -> Column:
    out = reduce(lambda w, kv: w.when(F.col(c) == kv[0], float(kv[1])), values.items(), F.when(F.lit(False), 0.0))
    return out.otherwise(default)


def estimate(specs: DataFrame) -> DataFrame:
    """specs with oil and motion, rounded half to even and held to their scales."""

    def held(x: Column, span: tuple[int, int]) -> Column:
        return F.greatest(F.lit(span[0]), F.least(F.lit(span[1]), F.bround(x, 0).cast("int")))

    oil = _lookup("cover_material", OIL_BASE, OIL_DEFAULT) + _lookup("cover_type", OIL_BY_TYPE, 0.0) + F.when(F.col("has_particle"), PARTICLE_OIL).otherwise(0)
    swing = F.coalesce((F.col("differential") - DIFF_MIDPOINT) / DIFF_SCALE * DIFF_WEIGHT, F.lit(0.0))
    motion = _lookup("core_type", MOTION_BASE, MOTION_DEFAULT) + swing + _lookup("cover_type", MOTION_BY_TYPE, 0.0)
    return specs.withColumn("oil", held(oil, OIL_RANGE)).withColumn("motion", held(motion, MOTION_RANGE))


def fill_estimates(products: DataFrame, specs: DataFrame, again: bool = False) -> DataFrame:
    """products(product, oil_rating, motion_rating, oil_motion_source) with estimates from specs where no rating is known.

    again: estimates made before are made anew, and nothing else changes; ratings of other sources always stay.
    """
    e = estimate(specs).select("product", F.col("oil").alias("__oil"), F.col("motion").alias("__motion"))
    due = (F.col("oil_motion_source") == "estimated") if again else F.col("oil_rating").isNull()
    due = F.coalesce(due, F.lit(False)) & F.col("__oil").isNotNull()
    made = {"oil_rating": F.col("__oil"), "motion_rating": F.col("__motion"), "oil_motion_source": F.lit("estimated")}
    j = products.join(e, "product", "left")
    return j.select(*(F.when(due, made[c]).otherwise(F.col(c)).alias(c) if c in made else F.col(c) for c in products.columns))


def accuracy(df: DataFrame, estimated: str, real: str) -> DataFrame:
    """One row: mean absolute error, exact and within-two counts of an estimate."""
    off = F.abs(F.col(estimated) - F.col(real))
    return df.agg(F.avg(off.cast("double")).alias("mae"), F.count_if(off == 0).alias("exact"), F.count_if(off <= 2).alias("within_two"), F.count("*").alias("n"))


def solved(gram: np.ndarray, moment: np.ndarray, tiny: float = 1e-10) -> np.ndarray:
    """x with gram x = moment by elimination, the largest remaining diagonal first; terms that others determine get 0."""
    a, b = gram.astype(float).copy(), moment.astype(float).copy()
    scale = np.where(np.diag(a) > 0, np.diag(a), 1.0)
    left, used = set(range(len(b))), []
    while left:
        i = max(left, key=lambda j: (a[j, j] / scale[j], -j))
        if a[i, i] / scale[i] <= tiny:
            break
        left.remove(i)
        used.append(i)
        for j in left:
            f = a[j, i] / a[i, i]
            a[j] -= f * a[i]
            b[j] -= f * b[i]
    x = np.zeros(len(b))
    for i in reversed(used):
        x[i] = (b[i] - a[i] @ x) / a[i, i]
    return x


def refit(df: DataFrame, target: str, numbers: list[str], kinds: dict[str, list[str]] | None = None) -> DataFrame:
    """(term, coefficient) of the least squares of a target on numbers and on indicators of the values of kinds.

    The Gram matrix is one aggregate, a row at the driver. Rows with an unknown target or number are left out; an unknown
    kind is no value. Terms that the others determine, or that never vary, get 0. No rows give 0 throughout.
    """
    terms = {"intercept": F.lit(1.0)} | {n: F.col(n).cast("double") for n in numbers}
    terms |= {f"{k}={v}": F.coalesce((F.col(k) == v).cast("double"), F.lit(0.0)) for k, values in (kinds or {}).items() for v in values}
    names = list(terms)
    known = reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in numbers], F.col(target).isNotNull())
    x = df.filter(known).select(F.col(target).cast("double").alias("y"), *(c.alias(f"x{i}") for i, c in enumerate(terms.values())))
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    row = x.agg(*(F.sum(F.col(f"x{i}") * F.col(f"x{j}")) for i, j in pairs), *(F.sum(F.col(f"x{i}") * F.col("y")) for i in range(len(names)))).first()
    values = np.array([v or 0.0 for v in row])
    gram = np.zeros((len(names), len(names)))
    for (i, j), v in zip(pairs, values):
        gram[i, j] = gram[j, i] = v
    found = solved(gram, values[len(pairs) :])
    return df.sparkSession.createDataFrame([(n, float(v)) for n, v in zip(names, found)], "term string, coefficient double")


def predicted(df: DataFrame, coefficients: DataFrame, name: str) -> DataFrame:
    """df with the prediction of refit's terms; null where a number is unknown."""
    total = F.lit(0.0)
    for term, value in coefficients.collect():  # a row for each term
        kind, _, level = term.partition("=")
        total = total + F.lit(value) * (F.lit(1.0) if term == "intercept" else F.coalesce((F.col(kind) == level).cast("double"), F.lit(0.0)) if level else F.col(term).cast("double"))
    return df.withColumn(name, total)
