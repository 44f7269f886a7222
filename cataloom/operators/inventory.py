"""Stock time series: average daily units (ADU), totals, growth, days of supply, history and forecast.

Every function takes its as-of time. Readings are partitioned by SKU, so the delta window and the sum per SKU share one
shuffle; nothing is collected.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86400.0


def seconds(c: str | Column):
    return F.unix_micros(c) / F.lit(1e6)


def _window(stock: DataFrame, as_of: datetime, from_days: int, to_days: int) -> DataFrame:
    t = F.lit(as_of)
    inside = stock.filter(F.col("checked_at") >= t - F.make_dt_interval(F.lit(from_days)))
    return inside.filter(F.col("checked_at") < t - F.make_dt_interval(F.lit(to_days))) if to_days else inside


def adu(stock: DataFrame, as_of: datetime, from_days: int = 30, to_days: int = 0) -> DataFrame:
    """(sku, adu): units sold a day between readings of the window; null over no time, absent below two readings."""
    last = F.lag("quantity").over(Window.partitionBy("sku").orderBy("checked_at", "id"))
    d = _window(stock, as_of, from_days, to_days).withColumn("drop", last - F.col("quantity"))
    sold = F.coalesce(F.sum(F.when(F.col("drop") > 0, F.col("drop"))), F.lit(0))
    days = (F.max(seconds("checked_at")) - F.min(seconds("checked_at"))) / DAY
    g = d.groupBy("sku").agg(sold.alias("sold"), days.alias("days"), F.count("*").alias("n")).filter("n >= 2")
    return g.select("sku", F.when(F.col("days") > 0, F.col("sold") / F.col("days")).alias("adu"))


def product_adu(stock: DataFrame, skus: DataFrame, as_of: datetime, from_days: int = 30) -> DataFrame:
    """(product, total_adu) for every product with SKUs; 0 where nothing is known."""
    a = adu(stock, as_of, from_days)
    return skus.join(a, "sku", "left").groupBy("product").agg(F.coalesce(F.sum("adu"), F.lit(0.0)).alias("total_adu"))


def brand_adu(stock: DataFrame, skus: DataFrame, products: DataFrame, as_of: datetime, from_days: int = 30) -> DataFrame:
    """(brand, total_adu) of every brand, brands without sales included."""
    per = product_adu(stock, skus, as_of, from_days)
    j = products.select("product", "brand").join(per, "product", "left")
    return j.groupBy("brand").agg(F.coalesce(F.sum("total_adu"), F.lit(0.0)).alias("total_adu"))


def adu_change(stock: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    """(sku, current, previous, change) of SKUs with an ADU in both windows; one scan, one shuffle."""
    both = _window(stock, as_of, 2 * days, 0).repartition("sku")
    now = (F.col("checked_at") >= F.lit(as_of) - F.make_dt_interval(F.lit(days))).alias("now")
    last = F.lag("quantity").over(Window.partitionBy("sku", "now").orderBy("checked_at", "id"))
    d = both.select("sku", "id", "quantity", "checked_at", now).withColumn("drop", last - F.col("quantity"))

    def own(inside: Column) -> Column:
        at = F.when(inside, seconds("checked_at"))
        sold = F.coalesce(F.sum(F.when(inside & (F.col("drop") > 0), F.col("drop"))), F.lit(0))
        span = (F.max(at) - F.min(at)) / DAY
        return F.struct(F.count_if(inside).alias("n"), F.when(span > 0, sold / span).alias("adu"))

    g = d.groupBy("sku").agg(own(F.col("now")).alias("a"), own(~F.col("now")).alias("b")).filter("a.n >= 2 and b.n >= 2")
    return g.select("sku", F.col("a.adu").alias("current"), F.col("b.adu").alias("previous"), (F.col("a.adu") - F.col("b.adu")).alias("change"))


def latest_reading(stock: DataFrame) -> DataFrame:
    """(sku, quantity, checked_at) of the last reading that has a quantity."""
    known = stock.filter("quantity is not null")
    last = F.max_by(F.struct("quantity", "checked_at"), F.struct("checked_at", "id"))
    return known.groupBy("sku").agg(last.alias("x")).select("sku", "x.*")


def days_of_supply(stock: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    """(sku, quantity, adu, days_of_supply) of SKUs that have stock and sell."""
    j = latest_reading(stock).filter("quantity > 0").join(adu(stock, as_of, days).filter("adu > 0"), "sku")
    return j.select("sku", "quantity", "adu", (F.col("quantity") / F.col("adu")).alias("days_of_supply"))


#: Days of the chart ranges; a projection over all of history takes ALL_DAYS.
RANGES = {"7D": 7, "30D": 30, "90D": 90, "1Y": 365, "All": None}
ALL_DAYS = 90


def in_range(time: str, preset: str, as_of: datetime) -> Column:
    days = RANGES[preset]
    return F.lit(True) if days is None else F.col(time) >= F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days))


def forecast(stock: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    """(sku, quantity, adu, days_of_supply, urgency, stockout_at): none left is 0 days and now, nothing sold is unknown."""
    now = F.lit(as_of).cast("timestamp")
    j = latest_reading(stock).join(adu(stock, as_of, days), "sku", "left")
    dos = F.when(F.col("quantity") <= 0, F.lit(0.0)).when(F.col("adu") > 0, F.col("quantity") / F.col("adu"))
    urgency = F.when(F.col("days_of_supply") <= 14, "danger").when(F.col("days_of_supply") <= 30, "muted").otherwise("ok")
    stockout = F.timestamp_seconds(F.unix_timestamp(now) + F.floor(F.col("days_of_supply") * 86400))
    return j.select("sku", "quantity", "adu", dos.alias("days_of_supply")).withColumns({"urgency": urgency, "stockout_at": stockout})


def projection(stock: DataFrame, as_of: datetime, days: int = 30, preset: str = "All") -> DataFrame:
    """(sku, day, quantity): what is left after each day until the stock or the range ends."""
    span = F.lit(float(RANGES[preset] or ALL_DAYS))
    f = forecast(stock, as_of, days)
    last = F.floor(F.least(F.coalesce("days_of_supply", F.lit(float(ALL_DAYS))), span)).cast("long")
    rows = f.select("sku", "quantity", "adu", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("day"))
    return rows.select("sku", "day", F.greatest(F.lit(0.0), F.col("quantity") - F.coalesce("adu", F.lit(0.0)) * F.col("day")).alias("quantity"))


def daily_units(stock: DataFrame) -> DataFrame:
    """(dd, units) sold per day, deltas over the whole history."""
    last = F.lag("quantity").over(Window.partitionBy("sku").orderBy("checked_at", "id"))
    d = stock.withColumn("drop", last - F.col("quantity")).filter("drop > 0")
    return d.groupBy(F.to_date("checked_at").alias("dd")).agg(F.sum("drop").cast("long").alias("units"))


def history(stock: DataFrame, days: int = 30) -> DataFrame:
    """(dd, units, adu): every day of the history with the mean of the days up to it; the window runs over days only."""
    span = stock.agg(F.min(F.to_date("checked_at")).alias("a"), F.max(F.to_date("checked_at")).alias("z"))
    spine = span.select(F.explode(F.sequence("a", "z")).alias("dd"))
    per_day = spine.join(daily_units(stock), "dd", "left").withColumn("units", F.coalesce("units", F.lit(0).cast("long")))
    w = Window.orderBy("dd").rowsBetween(1 - days, 0)  # one row for each day
    return per_day.select("dd", "units", (F.sum("units").over(w) / F.lit(float(days))).alias("adu"))


def in_stock(stock: DataFrame) -> DataFrame:
    """(sku, in_stock): null if no reading is known, else whether any is above 0."""
    return stock.groupBy("sku").agg(F.bool_or(F.col("quantity") > 0).alias("in_stock"))
