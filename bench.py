"""Headline timings as one JSON line.

``BENCH_SF_DIR`` names the tables and ``BENCH_CPUS`` the local threads. Every
timing runs its whole plan from the Parquet table; nothing is reused between
them except the graph that is searched.
"""

from __future__ import annotations

import json
import os
import time

from nearfield.operators.candidates import build_candidates
from nearfield.operators.carve import build_partition
from nearfield.operators.cells import approx_baseline
from nearfield.operators.evaluate import recall_at_k
from nearfield.operators.knn import exact_knn_graph, exact_topk, ground_truth
from nearfield.operators.search import beam_search
from nearfield.params import BuildParams, SearchParams
from nearfield.plans.build import build_graph
from nearfield.runtime import materialize, session, ship_package
from nearfield.sources.tables import as_queries, read_points

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def main() -> None:
    spark = session(
        "nearfield-bench",
        master=f"local[{CPUS}]",
        **{
            "spark.sql.shuffle.partitions": CPUS,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "12g",
        },
    )
    spark.sparkContext.setLogLevel("OFF")
    ship_package(spark)
    points = read_points(spark, f"{SF_DIR}/embeddings.parquet")
    queries = as_queries(points)
    params, search = BuildParams(), SearchParams(beam=128)
    seconds, recall, edges = {}, {}, {}

    def timed(name, make):
        start = time.monotonic()
        result = make()
        result.write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.monotonic() - start, 3)
        return result

    # One untimed build starts the Python workers and warms up the JVM.
    build_graph(points, "hash", params).write.format("noop").mode("overwrite").save()

    truth = materialize(ground_truth(points, queries, 10), "truth")
    timed("exact_topk", lambda: exact_topk(points, queries, 10))
    timed("exact_topk_ip", lambda: exact_topk(points, queries, 10, "ip"))
    timed("exact_knn_graph", lambda: exact_knn_graph(points, params.prune.max_degree))
    timed("partition", lambda: build_partition(points, params.carve).leaves)
    timed("candidates", lambda: build_candidates(points, params.candidates()).edges)
    for mode in ("hash", "refined", "exact"):
        start = time.monotonic()
        graph = materialize(build_graph(points, mode, params), "graph")
        seconds[f"build_{mode}"] = round(time.monotonic() - start, 3)
        edges[mode] = graph.count()
        start = time.monotonic()
        found = materialize(beam_search(graph, points, queries, search), "found")
        seconds[f"search_{mode}"] = round(time.monotonic() - start, 3)
        recall[mode] = round(recall_at_k(truth, found, 10).first()["recall"], 4)
    cells = timed("approx_baseline", lambda: approx_baseline(points, queries, 10))
    recall["cells"] = round(recall_at_k(truth, cells, 10).first()["recall"], 4)
    count = queries.count()
    qps = {m: round(count / seconds[f"search_{m}"], 1) for m in ("hash", "refined", "exact")}
    print(
        json.dumps(
            {
                "metric": "total_wall_clock",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": SF_DIR.rstrip("/").rsplit("/", 1)[-1].removeprefix("sf"),
                "recall_at_10": recall,
                "qps": qps,
                "edges": edges,
                "vectors": count,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
