"""Summarise the physical plans of the registered queries (from ``explain('formatted')``).

Usage: python tools/explain_plans.py [sf_dir] > PLANS.md
For each query: scans with their read schema width and pushed filters,
exchanges (shuffle / broadcast / single), join strategies, aggregate kinds,
top-k and window operators. Plans are taken before execution (AQE may still
turn a sort-merge join into a broadcast at runtime).
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

HEADLINE = [
    "hourly_demand_revenue", "weekend_vs_weekday_hourly", "payment_split", "top_pickup_grids",
    "regime_baseline", "regime_deviation_summary", "deviation_by_time", "deviation_top_grids",
    "decomposition_by_time", "toll_heavy_grids", "deviation_by_time_exact", "group_percentiles",
    "group_percentiles_exact", "group_percentiles_sketch", "lineitem_price_deviation", "ml_fare_dataset",
    "topn_or_other", "violation_counts", "clean_modelling", "suite_hourly_demand_revenue",
    "suite_regime_baseline", "suite_deviation_by_time",
]


def plan_text(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def summarise(text: str) -> dict:
    ops = re.findall(r"^\((\d+)\) (\w[\w ]*?)\s*$", text, flags=re.M)
    names = [o[1].strip() for o in ops]
    pushed = re.findall(r"PushedFilters: \[(.*)\]", text)
    schemas = re.findall(r"ReadSchema: struct<(.*)>", text)
    exch = re.findall(r"Arguments: (hashpartitioning|rangepartitioning|SinglePartition|RoundRobinPartitioning)",
                      text)
    return {
        "scans": sum(1 for n in names if n.startswith("Scan")),
        "read_cols": max((len(s.split(",")) for s in schemas), default=0),
        "pushed": max((len([p for p in f.split(", ") if p]) for f in pushed), default=0),
        "shuffles": ", ".join(exch) or "-",
        "broadcasts": sum(1 for n in names if n == "BroadcastExchange"),
        "joins": ", ".join(n for n in names if n.endswith("Join")) or "-",
        "aggregates": ", ".join(sorted({n for n in names if n.endswith("Aggregate")})) or "-",
        "other": ", ".join(sorted({n for n in names if n in ("TakeOrderedAndProject", "Window", "Sort")})) or "-",
    }


def main() -> None:
    from farewise.plans import catalog
    from farewise.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(8)
    print(f"# Physical plans (summary, {os.path.basename(sf_dir)}, before AQE re-planning)\n")
    print("| query | scans | read cols (max) | pushed filters (max) | exchanges | broadcasts | joins | aggregates | "
          "other |")
    print("|---|---|---|---|---|---|---|---|---|")
    for name in HEADLINE:
        s = summarise(plan_text(catalog.QUERIES[name](spark, sf_dir)))
        print(f"| {name} | {s['scans']} | {s['read_cols']} | {s['pushed']} | {s['shuffles']} | {s['broadcasts']} | "
              f"{s['joins']} | {s['aggregates']} | {s['other']} |")
    spark.stop()


if __name__ == "__main__":
    main()
