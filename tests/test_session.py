"""Scratch frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.session import written


def test_reading_a_wide_scratch_frame_keeps_no_buffers_outside_the_heap(spark):
    """A column of 60 MB in one file: threads that read ranges would keep a direct buffer as large as it."""
    wide = spark.range(0, 20_000, 1, 1).select("id", F.transform(F.sequence(F.lit(1), F.lit(400)), lambda i: F.xxhash64("id", i)).alias("s"))
    frame = written(wide, "wide")
    jvm = spark._jvm

    def direct() -> int:
        kind = jvm.java.lang.Class.forName("java.lang.management.BufferPoolMXBean")
        pools = jvm.java.lang.management.ManagementFactory.getPlatformMXBeans(kind)
        return sum(p.getMemoryUsed() for p in pools if p.getName() == "direct")

    before = direct()
    assert frame.agg(F.sum(F.size("s"))).first()[0] == 8_000_000
    assert direct() - before < 30 << 20
