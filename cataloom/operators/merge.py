"""Keyed merges, snapshot differences, survivors of duplicates and review transitions.

Parquet has no MERGE, so an upsert is one full outer join on the key; each column has a policy for rows in both tables.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OVERWRITE, NEW_ELSE_OLD, OLD_ELSE_NEW, KEEP = "overwrite", "new_else_old", "old_else_new", "keep"


def upsert(old: DataFrame, new: DataFrame, keys: list[str], policy: dict[str, str], computed: dict[str, Column] | None = None) -> DataFrame:
    """old with new merged in. Columns without a policy are overwritten; new must have each key once.

    computed: columns given as expressions over o.* and n.*; o.present and n.present tell whether a side has the key.
    """
    o = old.withColumn("present", F.lit(True)).alias("o")
    n = new.withColumn("present", F.lit(True)).alias("n")
    j = o.join(n, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys], "full")
    both_new = F.col("n.present").isNotNull()

    def value(c: str) -> Column:
        if computed and c in computed:
            return computed[c]
        if c not in new.columns:
            return F.col(f"o.{c}")
        a, b = F.col(f"o.{c}"), F.col(f"n.{c}")
        rule = policy.get(c, OVERWRITE)
        if rule == NEW_ELSE_OLD:
            return F.coalesce(b, a)
        if rule == OLD_ELSE_NEW:
            return F.coalesce(a, b)
        if rule == KEEP:
            return F.when(F.col("o.present").isNotNull(), a).otherwise(b)
        return F.when(both_new, b).otherwise(a)

    return j.select(*[F.coalesce(F.col(f"o.{k}"), F.col(f"n.{k}")).alias(k) for k in keys], *[value(c).alias(c) for c in old.columns if c not in keys])


#: Columns that a scrape doesn't know keep what was known.
KNOWN_STAYS = {c: NEW_ELSE_OLD for c in ("release_date", "description", "core_id", "coverstock_id")}


def upsert_products(old: DataFrame, new: DataFrame, platform: str, as_of: datetime) -> DataFrame:
    """A platform's scrape merged into the products, by URL. One platform knows neither weights nor when a product was retired, and leaves both as they are."""
    if platform == "commercebuild":
        left = {c: F.col(f"o.{c}") for c in ("discontinued_detected_at", "weights_available") if c in old.columns}
        return upsert(old, new, ["url"], KNOWN_STAYS, left)
    marks = {"discontinued_detected_at": _detected(as_of)} if "discontinued_detected_at" in old.columns else None
    return upsert(old, new, ["url"], KNOWN_STAYS, marks)


def upsert_skus(old: DataFrame, new: DataFrame, platform: str) -> DataFrame:
    """A platform's SKUs merged in by (product, weight): numbers are overwritten, a known mass bias isn't lost, and the source changes on one platform only."""
    return upsert(old, new, ["product", "weight_lbs"], {"mass_bias": NEW_ELSE_OLD, "source": OVERWRITE if platform == "commercebuild" else KEEP})


def _detected(as_of: datetime) -> Column:
    now = F.lit(as_of).cast("timestamp")
    o, n = F.col("o.status"), F.col("n.status")
    return F.when((n == "retired") & (F.coalesce(o, F.lit("")) != "retired"), now).when(n == "current", F.lit(None).cast("timestamp")).otherwise(F.col("o.discontinued_detected_at"))


def retired_at(as_of: datetime) -> Column:
    """When a product was first seen retired: set on the change, cleared when current again."""
    now = F.lit(as_of).cast("timestamp")
    o, n = F.col("o.status"), F.col("n.status")
    return F.when((n == "retired") & (F.coalesce(o, F.lit("")) != "retired"), now).when(n == "current", F.lit(None).cast("timestamp")).otherwise(F.col("o.retired_at"))


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, version: str, changes: bool = True) -> DataFrame:
    """(key, diff) for the keys of new: new, changed (another version) or unchanged; without changes never changed."""
    o = old.select(F.col(key).alias("okey"), F.col(version).alias("oversion"))
    j = new.join(o, new[key] == o["okey"], "left")
    same = F.col(version).eqNullSafe(F.col("oversion")) if changes else F.lit(True)
    return j.select(key, F.when(F.col("okey").isNull(), "new").when(~same, "changed").otherwise("unchanged").alias("diff"))


def fill_gaps(old: DataFrame, new: DataFrame, keys: list[str], values: list[str], tolerance: float) -> tuple[DataFrame, DataFrame]:
    """(merged, disagreements): new fills what old lacks; numbers that differ by more than the tolerance go to review."""
    merged = upsert(old, new, keys, {v: OLD_ELSE_NEW for v in values})
    numbers = [v for v in values if dict(old.dtypes)[v] != "string"]
    return merged, tolerance_review(old, new, keys, numbers, tolerance)


def tolerance_review(ours: DataFrame, theirs: DataFrame, keys: list[str], values: list[str], tolerance: float) -> DataFrame:
    """(keys, field_name, current_value, proposed_value) where both sides know a value and differ by more than the tolerance."""
    t = theirs.select(*keys, *[F.col(v).alias(f"their_{v}") for v in values])
    pairs = F.array(*[F.struct(F.lit(v).alias("field_name"), F.col(v).cast("double").alias("current_value"), F.col(f"their_{v}").cast("double").alias("proposed_value")) for v in values])
    j = ours.join(t, keys).select(*keys, F.explode(pairs).alias("x")).select(*keys, "x.*")
    return j.filter(F.abs(F.col("current_value") - F.col("proposed_value")) > tolerance)


def survivors(df: DataFrame, keys: list[str], order: list[Column], id_col: str) -> DataFrame:
    """(id, survivor): for each row the id of the first row of its key, in the order given, then by id."""
    w = Window.partitionBy(*keys).orderBy(*order, id_col)
    return df.select(F.col(id_col), F.first(id_col).over(w).alias("survivor"))


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("place", F.row_number().over(w)).filter("place = 1").drop("place")


def repoint(history: DataFrame, survivors: DataFrame, key: str) -> DataFrame:
    """history with keys of merged rows replaced by their survivors'."""
    s = survivors.select(F.col(survivors.columns[0]).alias(key), "survivor")
    return history.join(s, key, "left").withColumn(key, F.coalesce("survivor", key)).drop("survivor")


def review(status: Column, action: Column) -> Column:
    """The status after an action; null where the action isn't allowed."""
    return F.when((status == "pending") & (action == "approve"), "approved").when((status == "pending") & (action == "reject"), "rejected").when(status.isin("approved", "rejected") & (action == "restore"), "pending")


def insert_if_new(queue: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of found that no pending row of queue has, once for each key; null and empty keys are the same."""
    p = queue.filter("status = 'pending'").select(*[F.coalesce(F.col(k).cast("string"), F.lit("")).alias(f"q_{k}") for k in keys])
    cond = [F.coalesce(found[k].cast("string"), F.lit("")) == p[f"q_{k}"] for k in keys]
    new = found.join(p, cond, "left_anti")
    marks = {f"__{k}": F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys}
    return new.withColumns(marks).dropDuplicates(list(marks)).drop(*marks)


def message_batches(rows: DataFrame, queue: str, order: list[str], size: int = 10) -> DataFrame:
    """(queue, batch, messages): rows as JSON messages, size to a batch, in order."""
    place = F.row_number().over(Window.partitionBy(queue).orderBy(*order)) - 1
    numbered = rows.select(queue, F.floor(place / size).cast("long").alias("batch"), place.alias("at"), F.to_json(F.struct(*rows.columns)).alias("body"))
    return numbered.groupBy(queue, "batch").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "body"))), lambda m: m["body"]).alias("messages"))


def attempted(messages: DataFrame, most: int = 3) -> DataFrame:
    """messages(attempts, succeeded, ..) after one more attempt, with outcome: done, retry, or dead after most attempts."""
    tried = messages.withColumn("attempts", F.coalesce("attempts", F.lit(0)) + 1)
    return tried.withColumn("outcome", F.when(F.col("succeeded"), "done").when(F.col("attempts") >= most, "dead").otherwise("retry"))


def absolute(url: Column) -> Column:
    """Whether a URL names its scheme."""
    return F.coalesce(url, F.lit("")).rlike("^[A-Za-z][A-Za-z0-9+.-]*:")


def merge_duplicates(rows: DataFrame, keys: list[str], preferred: Column, created: str, id_col: str, url: str, histories: dict[str, tuple[DataFrame, str]]) -> tuple[DataFrame, dict[str, DataFrame], DataFrame]:
    """(rows with one of each key, histories on the survivors, counts).

    The survivor is a preferred row if there is one, then the oldest, then the smallest id. Its URL is kept if that is
    absolute; else it takes that of the next row of its key that has one. Ids are unique; a null key is a key. histories: table
    and its column of row ids; rows of unknown ids stay as they are. counts:
    groups_merged, rows_deleted, and history_rows before and after, which must be equal.
    """
    order = F.struct((~F.coalesce(preferred, F.lit(False))).alias("a"), F.col(created).alias("b"), F.col(id_col).alias("c"))
    first_absolute = F.min_by(F.when(absolute(F.col(url)), F.col(url)), F.when(absolute(F.col(url)), order))
    own = rows.groupBy(*keys).agg(F.min_by(F.struct(*rows.columns), order).alias("x"), first_absolute.alias("whole"), F.count("*").alias("n"))
    better = F.when(absolute(F.col(f"x.{url}")), F.col(f"x.{url}")).otherwise(F.coalesce("whole", f"x.{url}"))
    kept = own.select(*(better.alias(c) if c == url else F.col(f"x.{c}").alias(c) for c in rows.columns))
    survivor = own.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col(f"x.{id_col}").alias("survivor"))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    moved = rows.select(id_col, *keys).join(survivor, same).filter(F.col(id_col) != F.col("survivor")).select(id_col, "survivor")
    after = {name: repoint(h, moved.withColumnRenamed(id_col, column), column) for name, (h, column) in histories.items()}
    counts = own.agg(F.count_if(F.col("n") > 1).alias("groups_merged"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("rows_deleted"))
    for name, (h, column) in histories.items():
        there = after[name].join(kept.select(F.col(id_col).alias(column)), column, "left_semi")
        before = h.join(rows.select(F.col(id_col).alias(column)).distinct(), column, "left_semi")
        counts = counts.join(F.broadcast(before.agg(F.count("*").alias(f"{name}_before"))), how="cross").join(F.broadcast(there.agg(F.count("*").alias(f"{name}_after"))), how="cross")  # rows of one
    return kept, after, counts


def update_from(rows: DataFrame, found: DataFrame, key: str, column: str, by: str) -> DataFrame:
    """rows with the column of found (key, by) where that is known, and changed: whether it was another value; found has each key once."""
    j = rows.join(found.select(key, F.col(by).alias("__by")), key, "left")
    changed = F.coalesce(F.col("__by") != F.col(column), F.lit(False))
    return j.select(*(F.coalesce("__by", column).alias(c) if c == column else F.col(c) for c in rows.columns), changed.alias("changed"))


def missing_from(rows: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys other lacks; without rows in other, all. A null key is a key."""
    there = other.select(*(F.col(k).alias(f"__{k}") for k in keys)).distinct()
    return rows.join(there, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], "left_anti")


def keyed_union(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of first, and those of second whose keys first lacks."""
    return first.unionByName(missing_from(second, first, keys))
