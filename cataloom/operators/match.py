"""Matching of catalogs: names, weights, slugs and word overlap, all as equi-joins."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.text import normalize_name, token_key

FLOOR = 0.90


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity; runs only on pairs that have passed the token gate."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)])


def name_matches(ours: DataFrame, theirs: DataFrame, exact_ratio: bool = True) -> DataFrame:
    """(our_id, their_id, exact, ratio): for each of ours the best of theirs, null if there is none.

    ours(id, name), theirs(id, name, position). An equal normalized name wins, first by position; else a name that differs
    in generic words only, of the best ratio. Both are equi-joins, so no pair of unlike names is made.
    """
    o = ours.select(F.col("id").alias("our_id"), normalize_name(F.col("name")).alias("on"), token_key(F.col("name")).alias("key"))
    t = theirs.select(F.col("id").alias("their_id"), normalize_name(F.col("name")).alias("tn"), token_key(F.col("name")).alias("key"), "position")
    first = t.groupBy("tn").agg(F.min_by("their_id", F.struct("position", "their_id")).alias("their_id"))
    exact = o.join(first, F.col("on") == F.col("tn")).select("our_id", "their_id", F.lit(True).alias("exact"), F.lit(1.0).alias("ratio"))
    # of equal normalized names within a key only the first can win
    distinct = t.groupBy("key", "tn").agg(F.min(F.struct("position", "their_id")).alias("x")).select("key", "tn", "x.*")
    loose = o.join(exact.select("our_id"), "our_id", "left_anti").join(distinct, "key")
    ratio = F.greatest(sequence_ratio("on", "tn"), F.lit(FLOOR)) if exact_ratio else F.lit(FLOOR)
    scored = loose.select("our_id", "their_id", "position", ratio.alias("ratio"))
    w = Window.partitionBy("our_id").orderBy(F.desc("ratio"), "position", "their_id")
    best = scored.withColumn("place", F.row_number().over(w)).filter("place = 1")
    found = exact.union(best.select("our_id", "their_id", F.lit(False).alias("exact"), "ratio"))
    return o.select("our_id").join(found, "our_id", "left")


def weight_matches(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(product, weight, ours, theirs, side): one-to-one by product and weight to two decimals, in order of ids.

    The n-th of ours of a weight meets the n-th of theirs; side tells matched, ours_only or theirs_only.
    """

    def numbered(df: DataFrame, name: str) -> DataFrame:
        d = df.withColumn("weight", F.round(F.col("weight").cast("decimal(10,4)"), 2))
        w = Window.partitionBy("product", "weight").orderBy("id")
        return d.select("product", "weight", F.row_number().over(w).alias("n"), F.col("id").alias(name))

    j = numbered(ours, "ours").join(numbered(theirs, "theirs"), ["product", "weight", "n"], "full")
    side = F.when(F.col("ours").isNull(), "theirs_only").when(F.col("theirs").isNull(), "ours_only").otherwise("matched")
    return j.select("product", "weight", "ours", "theirs", side.alias("side"))


def unique_matches(entries: DataFrame, products: DataFrame) -> DataFrame:
    """(entry, product, outcome) of entries(entry, brand, name): matched only if one product of the brand has the name."""
    b = products.select(F.lower(F.trim("brand")).alias("b")).distinct().withColumn("known", F.lit(True))
    p = products.groupBy(F.lower(F.trim("brand")).alias("b"), F.lower(F.trim("name")).alias("k")).agg(F.count("*").alias("n"), F.min("product").alias("product"))
    e = entries.select("entry", F.lower(F.trim("brand")).alias("b"), F.lower(F.trim("name")).alias("k"))
    j = e.join(b, "b", "left").join(p, ["b", "k"], "left")
    outcome = F.when(F.col("known").isNull(), "no_brand").when(F.col("n").isNull(), "no_match").when(F.col("n") > 1, "ambiguous").otherwise("matched")
    return j.select("entry", F.when(F.col("n") == 1, F.col("product")).alias("product"), outcome.alias("outcome"))


def plausible(a, b):
    """Whether two names share a word of three letters or more."""
    long = lambda c: F.filter(F.split(normalize_name(c), " "), lambda w: F.length(w) >= 3)
    return F.arrays_overlap(long(a), long(b))


def coverage_gap(matches: DataFrame) -> DataFrame:
    """Review rows for products without a match."""
    return matches.filter("their_id is null").select("our_id", F.lit("listing").alias("field_name"), F.lit("missing").alias("reason"))


