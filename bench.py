"""Times the headline queries and prints one JSON line."""

import json
import os
import time

from cataloom.plans import more, remote, rules, sources, streams, upkeep  # noqa: F401  (register their queries)
from cataloom.plans.queries import REGISTERED
from cataloom.session import get_session

HEADLINE = [
    "adu_by_sku", "adu_growth", "product_total_adu", "brand_total_adu", "days_of_supply_top10", "catalog_adu_history", "popularity_top10",
    "similar_products", "latest_price", "kpi_summary", "upsert_products", "dedupe_reparent", "fuzzy_name_match", "weight_match_full_outer", "page_links",
    "kpi_row", "best_images", "reviews_resolved", "duplicates_kept", "nearest_products", "refit_motion", "selector_prices", "sheet_numbers",
]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = get_session(f"local[{cpus}]", "bench", int(cpus) if cpus.isdigit() else 8, **{"spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        times = []
        for _ in range(3):
            t = time.perf_counter()
            REGISTERED[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - t)
        took[name] = round(sorted(times)[1], 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
