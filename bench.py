"""Headline queries with wall times; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores. Each time
covers planning, execution and a full read of the result. The stage tables a query needs are built inside
the first query that needs them; `panel_build` is the scan, join and aggregate of the line table alone.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINES = (
    "session_returns", "canonical_price_features", "liquidity_features", "reversal_signal_set", "recursive_indicators",
    "decile_long_short_stream", "calendar_feature_table", "calendar_trial_grid", "latest_view_before_purchase", "retained_intraday_rows",
    "eligible_members", "instrument_audit", "rebased_reconciliation", "trial_streams", "hac_mean_tests", "return_summaries",
    "multiple_testing", "cost_sensitivity_and_capacity", "correlation_clusters", "walk_forward_evidence", "overfitting_probability",
    "turn_of_month_episodes", "monthly_cross_section_study", "streamed_minute_bars",
)


def main() -> None:
    from pyspark.sql import functions as F

    from chronopanel.operators import bootstrap as B
    from chronopanel.plans import load
    from chronopanel.plans.validation import family, size, values
    from chronopanel.session import local_session
    from chronopanel.sources import panel as P

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, shuffle_partitions=int(cores), memory="12g")
    spark.sparkContext.setLogLevel("OFF")
    times: dict[str, float] = {}

    def timed(name, run):
        start = time.time()
        run().write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)

    spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().collect()
    timed("panel_build", lambda: P.build_bars(*[P.table(spark, sf_dir, t) for t in ("lineitem", "supplier", "nation")]))
    catalogue = load()
    for name in HEADLINES:
        timed(name, lambda q=catalogue[name]: q.run(spark, sf_dir))

    def bootstrap_2000():
        n = size(spark, sf_dir)
        counts = B.date_counts(B.stationary_paths(spark, n, 2000))
        return B.family_p_values(B.blocked_maxima(counts, values(spark, sf_dir), family(spark, sf_dir), n), family(spark, sf_dir))

    timed("stationary_bootstrap_2000_draws", bootstrap_2000)
    spark.stop()
    print(json.dumps({"metric": "total_wall_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", "")}))


if __name__ == "__main__":
    main()
