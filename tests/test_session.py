"""The driver's heap between the steps of long plans."""

import time

from entwine.functions import session


def test_a_grown_heap_is_collected_when_a_table_is_stored(spark, monkeypatch):
    """Beyond the share only, and not within the pause: before, what hundreds of stages leave stayed until the heap was full."""
    calls, release = [], session.release
    monkeypatch.setattr(session, "release", lambda s: calls.append(s) or release(s))
    monkeypatch.setattr(session, "HEAP_SHARE", 1.0)
    monkeypatch.setattr(session, "_RELIEVED", [time.monotonic() - 600])
    session.stored(spark.range(3).toDF("x"), "small-heap")
    assert not calls
    monkeypatch.setattr(session, "HEAP_SHARE", 0.0)
    out = session.stored(spark.range(3).toDF("x"), "grown-heap")
    monkeypatch.setattr(session, "PAUSE", 600.0)
    session.stored(spark.range(3).toDF("x"), "within-the-pause")
    assert calls == [spark]
    assert sorted(r.x for r in out.collect()) == [0, 1, 2]
