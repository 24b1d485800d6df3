"""Scratch folder rules: the session's checkpoint dir, a local temporary folder only in local mode."""

import threading

import pytest

from churnlens import session
from churnlens.session import scratch_dir, scratch_path


class _Conf:
    def __init__(self, values):
        self.values = values

    def get(self, key, default=None):
        return self.values.get(key, default)


class _Context:
    def __init__(self, master, checkpoint=None):
        self.master, self.checkpoint = master, checkpoint

    def getCheckpointDir(self):
        return self.checkpoint

    def setCheckpointDir(self, d):
        self.checkpoint = d


class _Session:
    def __init__(self, master, checkpoint=None, conf=None):
        self.sparkContext = _Context(master, checkpoint)
        self.conf = _Conf(conf or {})


def test_cluster_session_without_checkpoint_dir_is_refused():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch_dir(_Session("yarn"))


def test_cluster_session_uses_its_configured_folder():
    s = _Session("spark://head:7077", conf={"spark.checkpoint.dir": "hdfs:///shared/ckpt"})
    assert scratch_dir(s) == "hdfs:///shared/ckpt"
    assert scratch_dir(_Session("yarn", checkpoint="hdfs:///shared/other/")) == "hdfs:///shared/other"


def test_local_session_gets_a_temporary_folder():
    s = _Session("local[4]")
    d = scratch_dir(s)
    assert d and s.sparkContext.getCheckpointDir() == d


def test_scratch_is_removed_at_the_end(spark):
    from churnlens.session import remove_scratch
    path = scratch_path(spark, "gone")
    spark.range(3).write.parquet(path)
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    before = session._PATHS.pop(spark.sparkContext.applicationId)
    kept = [dict(c) for c in session._CACHES]
    session._PATHS[spark.sparkContext.applicationId] = [path]              # other tests still read theirs
    assert fs.exists(fs_path) and remove_scratch(spark) == 1 and not fs.exists(fs_path)
    session._PATHS[spark.sparkContext.applicationId] = [p for p in before if p != path]
    for cache, old in zip(session._CACHES, kept):
        cache.update(old)


def test_queries_work_after_the_scratch_is_removed(spark):
    """What was loaded is forgotten with its files and loaded anew."""
    cache = session.scratch_cache()
    app = spark.sparkContext.applicationId
    cache[app, "mine"], cache["another application", "its"] = 1, 2
    old, kept = session._PATHS.pop(app, []), {id(c): dict(c) for c in session._CACHES}
    try:
        assert session.remove_scratch(spark) == 0 and cache == {("another application", "its"): 2}
        assert not any(k[0] == app for c in session._CACHES for k in c)
    finally:                                                               # other tests still read theirs
        session._PATHS[app] = old
        for c in session._CACHES:
            c.update({k: v for k, v in kept[id(c)].items() if c is not cache})
        session._CACHES.remove(cache)


def test_scratch_of_a_scope_goes_with_it(spark):
    """Only what the scope's own thread has written, and what was there before stays."""
    exists = lambda p: (at := spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    made = {}

    def write(name):
        made[name] = scratch_path(spark, name)
        spark.range(3).write.parquet(made[name])

    write("before")
    with pytest.raises(ValueError), session.scratch_scope(spark):
        write("within")
        with session.scratch_scope(spark):
            write("inner")
        assert exists(made["within"]) and not exists(made["inner"])
        other = threading.Thread(target=write, args=("elsewhere",))
        other.start()
        other.join()
        raise ValueError
    assert [exists(made[n]) for n in ("before", "within", "elsewhere")] == [True, False, True]
    paths = session._PATHS[spark.sparkContext.applicationId]
    assert made["before"] in paths and made["within"] not in paths
    session.delete_scratch(spark, [made["before"], made["elsewhere"]])
    assert not exists(made["before"]) and made["elsewhere"] not in paths
