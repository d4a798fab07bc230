"""Checkpoint-folder resolution: read from the session, private fallback only
when unset (``spark.checkpoint.dir`` cannot be set at runtime in Spark 4)."""

import os

import pytest

from herdflow import session


class _Conf:
    def __init__(self, value):
        self.value = value

    def get(self, key, default=None):
        return self.value if key == "spark.checkpoint.dir" and self.value else default

    def set(self, key, value):  # pragma: no cover - must never be called
        raise AssertionError("spark.checkpoint.dir must not be set at runtime")


class _Ctx:
    def __init__(self, master="local[2]"):
        self.dir = None
        self.master = master

    def getCheckpointDir(self):
        return self.dir

    def setCheckpointDir(self, d):
        self.dir = d


class _Spark:
    def __init__(self, value):
        self.conf = _Conf(value)
        self.sparkContext = _Ctx()


def test_uses_configured_folder():
    s = _Spark("/shared/ckpt")
    assert session.checkpoint_dir(s) == "/shared/ckpt"
    assert s.sparkContext.dir == "/shared/ckpt"
    assert session.scratch_path(s, "x").startswith("/shared/ckpt/x-")


def test_cluster_without_a_shared_folder_is_refused():
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        s = _Spark(None)
        s.sparkContext = _Ctx(master)
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            session.checkpoint_dir(s)


def test_private_fallback_when_unset_and_local():
    s = _Spark(None)
    d = session.checkpoint_dir(s)
    assert os.path.isdir(d) and s.sparkContext.dir == d
    assert session.checkpoint_dir(_Spark(None)) == d      # one folder per process


def test_real_session_reads_setting(spark):
    d = session.checkpoint_dir(spark)
    assert d and spark.sparkContext.getCheckpointDir() is not None
