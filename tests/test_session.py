"""Scratch tables: scopes delete what isn't handed out; no local folder on a cluster."""

from __future__ import annotations

from pathlib import Path
from types import SimpleNamespace

import pytest

from conceptlake import session


def there(df):
    return Path(df.__dict__["_cut_path"].removeprefix("file:")).exists()


def test_scopes_delete_what_is_not_kept(spark):
    with session.scratch(spark) as keep:
        with session.scratch(spark) as inner:
            a, b = session.cut(spark.range(3)), inner(session.cut(spark.range(4)))
        assert not there(a) and there(b)
        c = keep(session.cut(spark.range(5)))
    assert not there(b) and c.count() == 5
    assert session.drop_cuts(spark) >= 1 and not there(c)


def test_a_failure_leaves_nothing(spark):
    with pytest.raises(ValueError), session.scratch(spark):
        a = session.cut(spark.range(3))
        raise ValueError
    assert not there(a)


def test_no_local_folder_on_a_cluster():
    cluster = SimpleNamespace(conf={}, sparkContext=SimpleNamespace(master="spark://h:7077", getCheckpointDir=lambda: None))
    with pytest.raises(RuntimeError):
        session.scratch_dir(cluster)


def test_tuned_bounds_batches(spark):
    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    other = spark.newSession()
    for given, want in ((("10000", "64m"), (session.ARROW_ROWS, session.ARROW_BYTES)), (("100", "1m"), (100, 1 << 20)), (("0", "8388608b"), (session.ARROW_ROWS, 8 << 20))):
        for k, v in zip(keys, given, strict=True):
            other.conf.set(k, v)
        session.tuned(other)
        rows, size = (other.conf.get(k) for k in keys)
        assert int(rows) == want[0] and size in (str(want[1]), "1m", "8388608b")
