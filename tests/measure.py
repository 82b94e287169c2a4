"""What an action moves, by Spark's own counters."""

from __future__ import annotations


def stages(spark) -> dict:
    gateway = spark.sparkContext._gateway
    none, empty = gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList()
    found = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, none, empty)
    return {(s.stageId(), s.attemptId()): s for s in (found.apply(k) for k in range(found.size()))}


def moved(spark, action) -> tuple[int, int]:
    """Records and bytes that the action writes to shuffles."""
    bus = spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty()
    before = set(stages(spark))
    action()
    bus.waitUntilEmpty()
    new = [s for k, s in stages(spark).items() if k not in before]
    return sum(s.shuffleWriteRecords() for s in new), sum(s.shuffleWriteBytes() for s in new)
