"""Times the headline queries and prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from quern.engine import connect
from quern.plans import catalogue

HEADLINE = ("q_agg_group_sum", "q_four_way_join", "q_like_ci", "q_pk_point", "q_index_range", "q_topk", "q_left_join_count", "q_count_distinct", "q_unique_violations", "q_update_effect")


def insert(spark: SparkSession, rows: int = 20_000) -> float:
    """Seconds to insert rows one by one in a transaction, into a table with a primary key and an index."""
    with connect(":memory:", spark) as db:
        db.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, bucket INTEGER, name TEXT, score REAL); CREATE INDEX i ON t (bucket)")
        start = time.perf_counter()
        db.executemany("INSERT INTO t VALUES (?, ?, ?, ?)", ((k, k % 1000, f"name-{k}", k * 0.5) for k in range(rows)))
        return time.perf_counter() - start


def main() -> None:
    base, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC"}
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        runs = []
        for _ in range(2):
            start = time.perf_counter()
            catalogue.queries()[name](spark, base).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        took[name] = round(min(runs), 4)
    took["insert_20000_rows"] = round(min(insert(spark) for _ in range(2)), 4)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 4), "unit": "sec", "queries": took, "sf": base.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
