"""What a run took: time, peak memory of executors, bytes an edge."""

from __future__ import annotations

import time

from pyspark.sql import SparkSession

#: Peaks that Spark keeps for each executor, from its heartbeats; the Python ones need process tree metrics.
PARTS = ("JVMHeapMemory", "JVMOffHeapMemory", "ProcessTreePythonRSSMemory")


def peak_bytes(spark: SparkSession) -> int | None:
    """The largest sum of ``PARTS`` of one executor so far, from Spark's status store; None before the first heartbeat.

    In local mode the driver is the executor.
    """
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    found = []
    for i in range(executors.size()):
        summary = executors.apply(i)
        peaks = summary.peakMemoryMetrics()
        if peaks.isDefined() and (summary.id() != "driver" or executors.size() == 1):
            found.append(sum(max(0, peaks.get().getMetricValue(p)) for p in PARTS))
    return max(found, default=0) or None


class Run:
    """A context that measures what happens inside: ``ms``, ``peak``, and per edge after it.

    Executors report every ``spark.executor.heartbeatInterval``, and peaks are those since the session began.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.ms, self.peak = spark, 0.0, None

    def __enter__(self) -> Run:
        self._began = time.perf_counter()
        return self

    def __exit__(self, *_) -> None:
        self.ms = 1000 * (time.perf_counter() - self._began)
        self.peak = peak_bytes(self.spark)

    def per_edge(self, edges: int) -> float | None:
        return self.peak / edges if self.peak and edges else None
