"""Counts and times of statements, as a dictionary and as Prometheus text."""

from __future__ import annotations

import threading
import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

#: Seconds from which on a statement counts as slow.
SLOW = 1.0


class Metrics:
    """Safe to share between threads."""

    def __init__(self, slow: float = SLOW, clock=time.monotonic):
        self.slow, self.clock, self.began = slow, clock, clock()
        self.lock = threading.Lock()
        self.counts = dict.fromkeys(("total", "success", "failed", "slow_queries", "vertices_queried", "edges_queried"), 0)
        self.seconds = 0.0

    def add(self, name: str, n: int = 1) -> None:
        with self.lock:
            self.counts[name] += n

    @contextmanager
    def query(self) -> Iterator[None]:
        """Counts and times its body; an error in it is a failed query and goes on."""
        start, outcome = self.clock(), "failed"
        try:
            yield
            outcome = "success"
        finally:
            took = self.clock() - start
            with self.lock:
                self.counts["total"] += 1
                self.counts[outcome] += 1
                self.counts["slow_queries"] += took >= self.slow
                self.seconds += took

    def snapshot(self) -> dict[str, float]:
        with self.lock:
            out: dict[str, float] = dict(self.counts)
            seconds = self.seconds
        up = self.clock() - self.began
        out["avg_duration_ms"] = 1000 * seconds / out["total"] if out["total"] else 0.0
        out["qps"] = out["total"] / up if up > 0 else 0.0
        out["uptime_seconds"] = up
        return out


def storage(spark: SparkSession) -> dict[str, int]:
    """Bytes that executors may hold of cached tables, and those in use: what a buffer pool is elsewhere."""
    most = used = 0
    status = spark.sparkContext._jsc.sc().getExecutorMemoryStatus()
    each = status.valuesIterator()
    while each.hasNext():
        pair = each.next()
        most, used = most + pair._1(), used + pair._1() - pair._2()
    return {"most_bytes": most, "used_bytes": used}


#: Series: name, kind, key of the numbers, help.
SERIES = [
    ("ledgerlake_queries_total", "counter", "total", "Statements run"),
    ("ledgerlake_queries_success_total", "counter", "success", "Statements without an error"),
    ("ledgerlake_queries_failed_total", "counter", "failed", "Statements with an error"),
    ("ledgerlake_queries_slow_total", "counter", "slow_queries", "Statements beyond the slow threshold"),
    ("ledgerlake_query_duration_avg_ms", "gauge", "avg_duration_ms", "Mean time of a statement"),
    ("ledgerlake_qps", "gauge", "qps", "Statements a second since the start"),
    ("ledgerlake_vertices_queried_total", "counter", "vertices_queried", "Vertices looked up"),
    ("ledgerlake_edges_queried_total", "counter", "edges_queried", "Edge lookups"),
    ("ledgerlake_storage_bytes", "gauge", "most_bytes", "Executor memory for cached tables"),
    ("ledgerlake_storage_used_bytes", "gauge", "used_bytes", "Executor memory that cached tables use"),
    ("ledgerlake_uptime_seconds", "gauge", "uptime_seconds", "Seconds since the start"),
]


def prometheus(numbers: dict[str, float]) -> str:
    """Text exposition of the series whose numbers are given."""
    lines = []
    for name, kind, key, text in SERIES:
        if key in numbers:
            lines += [f"# HELP {name} {text}", f"# TYPE {name} {kind}", f"{name} {numbers[key]}"]
    return "\n".join(lines) + "\n"
