"""Times the headline queries; prints one JSON line. BENCH_SF_DIR and BENCH_CPUS set the input and the cores.

Tables that queries share are built in a folder of this run: nothing that an earlier run made is read, and the first query that needs
such a table pays for it.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from veldspar import catalog
from veldspar.session import session

HEADLINE = ["panel_features", "panel_trends", "peer_percentile_rank", "peer_benchmarks_quartiles", "rule_engine_summary", "rule_engine_indicators", "firm_period_rollup", "sensitivity_scenarios", "band_stability", "dashboard_firm_product", "star_fact", "star_dim_firm", "asof_rate", "series_half_year", "crosswalk_exact", "total_reconciliation", "column_profile", "schema_diff_full_outer"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    own = "file://" + tempfile.mkdtemp(prefix="veldspar-bench-")  # on local masters only, as here
    spark = session(f"local[{cpus}]", "bench", **{"spark.checkpoint.dir": own, "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    catalog.QUERIES["semi_join"](spark, sf).write.format("noop").mode("overwrite").save()  # starts the session's code paths
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
