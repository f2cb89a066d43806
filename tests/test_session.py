import pytest

from sparqa.session import checkpoint_dir


class _Conf:
    def __init__(self, values):
        self.values = values

    def get(self, key, default=None):
        return self.values.get(key, default)


class _Ctx:
    def __init__(self, master, configured=None):
        self.master = master
        self._dir = None
        self._conf = _Conf({"spark.checkpoint.dir": configured} if configured else {})

    def getCheckpointDir(self):
        return self._dir

    def setCheckpointDir(self, d):
        self._dir = d

    def getConf(self):
        return self._conf


class _Session:
    def __init__(self, master, configured=None):
        self.sparkContext = _Ctx(master, configured)
        self.conf = _Conf({})


def test_cluster_without_shared_folder_is_an_error():
    with pytest.raises(RuntimeError):
        checkpoint_dir(_Session("spark://head:7077"))


def test_configured_folder_wins():
    s = _Session("yarn", "hdfs:///shared/ckpt")
    assert checkpoint_dir(s) == "hdfs:///shared/ckpt"
    assert s.sparkContext.getCheckpointDir() == "hdfs:///shared/ckpt"


def test_local_master_gets_a_scratch_folder_only_when_unset():
    s = _Session("local[2]")
    d = checkpoint_dir(s)
    assert d and s.sparkContext.getCheckpointDir() == d
