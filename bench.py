"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is run once to warm up and then three times; the median counts.  Rows a second relate the
rows that an operator reads to its time, for the batched operators.  The store's scenarios time single
requests against a store in a temporary folder; their figures are requests a second (rows a second for
scans), reported apart and not part of the sum.
"""

from __future__ import annotations

import json
import os
import random
import statistics
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"

#: Query, and the table whose rows it reads.
HEADLINE = {
    "scan_full": "events", "scan_range": "events", "scan_limit": "events", "scan_merge_runs": "events", "multi_get": "events", "point_get_hit": "events",
    "flush_segments": "events", "compact_l0_to_l1": "events", "major_compact": "events", "wal_replay": "events", "wal_replay_corrupt_prefix": "events",
    "bloom_probe": "customer", "latency_stats": "events", "make_key": "orders", "scan_many_keys": "orders", "compact_many_keys": "orders",
}


def scenarios(spark) -> dict[str, dict]:
    """Requests a second, and nearest-rank p50 and p99 in microseconds, of each scenario."""
    from moraine.sources.service import Client, Service
    from moraine.sources.store import Store

    key, value, dice = lambda k: b"key_%012d" % k, b"v" * 100, random.Random(42)
    small, large, out = 64 << 10, 64 << 20, {}

    def timed(name: str, n: int, request, rows: int = 1) -> None:
        times = []
        for k in range(n):
            began = time.perf_counter()
            request(k)
            times.append(time.perf_counter() - began)
        whole = sum(times)
        times.sort()
        out[name] = {"per_sec": round(n * rows / whole, 1), "p50_us": round(1e6 * times[n * 50 // 100], 1), "p99_us": round(1e6 * times[n * 99 // 100], 1), "n": n}

    def store(size: int) -> Store:
        return Store.open(spark, tempfile.mkdtemp(prefix="moraine-bench-"), size)

    disk, memory = store(small), store(large)
    timed("put", 2000, lambda k: disk.put(key(k), value))
    for k in range(5000):
        memory.put(key(k), value)
    timed("get_memtable", 5000, lambda k: memory.get(key(k)))
    disk.flush()
    disk.compact()
    timed("get_sstable", 15, lambda k: disk.get(key(k * 100)))
    timed("get_miss", 15, lambda k: disk.get(key(10**6 + k)))
    asked = spark.range(2000).selectExpr("cast(format_string('key_%012d', id) as binary) AS key")
    timed("multi_get_sstable", 5, lambda k: disk.multi_get(asked).write.format("noop").mode("overwrite").save(), 2000)
    mixed = store(small)
    for k in range(50):
        mixed.put(key(k), value)
    timed("mixed_50_50", 300, lambda k: mixed.get(key(dice.randrange(50))) if dice.random() < 0.5 else mixed.put(key(dice.randrange(50)), value))
    timed("crash_recovery_5000_records", 5, lambda k: Store.open(spark, memory.file(""), large))
    timed("scan_500_rows", 10, lambda k: memory.scan(key(0), key(500)).collect(), 500)
    client = Client(Service(store(large)))
    timed("service_put", 1000, lambda k: client.put(key(k), value))
    timed("service_get_memtable", 1000, lambda k: client.get(key(k)))
    timed("service_scan_500_rows", 5, lambda k: client.scan(key(0), key(500)), 500)
    return out


def main() -> None:
    from pyspark.sql import SparkSession

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from moraine.plans.queries import QUERIES

    size = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet").count() for t in set(HEADLINE.values())}
    seconds, rates = {}, {}
    for name, table in HEADLINE.items():
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        runs = []
        for _ in range(3):
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        seconds[name] = round(statistics.median(runs), 4)
        rates[name] = round(size[table] / seconds[name])
    stores = scenarios(spark)
    spark.stop()
    print(json.dumps({"metric": "sum of median query seconds", "value": round(sum(seconds.values()), 4), "unit": "sec", "queries": seconds, "rows_per_sec": rates, "store": stores, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
