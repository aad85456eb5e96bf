"""Headline timings: one JSON line. BENCH_SF_DIR, BENCH_CPUS and BENCH_RUNS configure it."""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from factloom.model import DateRange, Filters, WhereIn  # noqa: E402
from factloom.operators import brief, dashboards, inference, kpis, paging, profiling  # noqa: E402
from factloom.plans.dashboard import dashboard_query  # noqa: E402
from factloom.plans.ingest import ingest  # noqa: E402
from factloom.plans.queries import (  # noqa: E402
    EVENT_KPIS,
    ORDER_KPIS,
    ORDER_WIDGETS,
    REGISTRY,
    STATUS,
    as_strings,
    flagged_events,
    table,
)
from factloom.session import build_session  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
# Registered queries measured as they are.
DIRECT = (
    "time_series_split", "time_series_fold", "time_series_zero_fill", "category_split_other", "category_distinct_other",
    "histogram_20", "filters_date_where", "filter_values", "kpis_default", "kpis_range", "period_changes", "robust_z",
    "drivers", "composition", "ungrounded_numbers", "monotonic_events", "sliding_rate_limit", "latency_percentiles",
    "latest_order", "purge",
)


def main() -> None:
    spark = build_session(
        f"local[{CPUS}]",
        **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": CPUS, "spark.driver.memory": "12g",
           "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    lines, orders, events = table(spark, SF_DIR, "lineitem"), table(spark, SF_DIR, "orders"), flagged_events(spark, SF_DIR)
    kinds = {"l_returnflag": "categorical", "l_linestatus": "categorical", "l_shipdate": "datetime"}
    types = {c: kinds.get(c, "numeric") for c in lines.columns}
    wanted = Filters(DateRange("o_orderdate", "1996-01-01", "1999-12-31"), (STATUS,))
    hot = orders.persist()
    hot.count()

    def dashboard() -> None:
        result = dashboard_query(hot, ORDER_WIDGETS, wanted, ORDER_KPIS, "o_orderdate", "o_orderkey")
        result.points.collect()
        result.kpis.collect()
        result.release()

    folder = tempfile.mkdtemp(prefix="factloom-bench-")
    raw = f"{folder}/lineitem.csv"
    csv = lines.select(*(F.col(c).cast("string").alias(c) for c in lines.columns))
    csv.coalesce(1).write.option("header", True).csv(raw)

    def facts() -> None:
        profiles = profiling.profile_table(events, {"event_id": "id", "ts": "datetime", "user_id": "id", "event_type": "categorical", "value": "numeric", "props": "text", "is_error": "boolean"}, "events")
        stored = spark.createDataFrame(profiles.collect(), profiles.schema)
        brief.build_facts(events, stored, dashboards.auto_dashboard(stored), "event_id").brief().collect()

    cases: dict[str, Callable[[], object]] = {
        "dashboard_query": dashboard,
        "rows_page": lambda: paging.rows_page(hot, wanted, "o_totalprice:desc", 1, 50, ["o_orderkey"]).collect(),
        "infer_types_lineitem": lambda: inference.plan_columns(as_strings(lines)),
        "profile_lineitem": lambda: profiling.profile_table(lines, types).collect(),
        "ingest_lineitem_csv": lambda: ingest(spark, next(f"{raw}/{f}" for f in os.listdir(raw) if f.endswith(".csv")), folder, "lineitem"),
        "facts_and_brief_events": facts,
        "kpis_events": lambda: kpis.compute_kpis(events, EVENT_KPIS, "ts", Filters(None, (WhereIn("event_type", ("click", "error")),))).collect(),
    }
    for name in DIRECT:
        cases[name] = lambda name=name: REGISTRY[name](spark, SF_DIR).collect()
    only = set(sys.argv[1:])
    seconds = {}
    for name, run in cases.items():
        if only and name not in only:
            continue
        timings = []
        for _ in range(RUNS + 1):
            started = time.perf_counter()
            run()
            timings.append(time.perf_counter() - started)
        # The first run compiles code and is left out, as in the reference's numbers.
        seconds[name] = round(statistics.median(timings[1:]), 4)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 4)
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": SF_DIR}))
    spark.stop()


if __name__ == "__main__":
    main()
