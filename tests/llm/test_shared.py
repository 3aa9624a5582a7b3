from types import SimpleNamespace

import pytest

from plazaworks.llm import shared


class Settings(dict):
    def set(self, key, value):
        self[key] = value


def session(master, **settings):
    return SimpleNamespace(conf=Settings(settings), sparkContext=SimpleNamespace(master=master))


def test_a_cluster_needs_a_shared_folder():
    for master in ("spark://host:7077", "yarn", "k8s://x", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            shared.shared_dir(session(master), "t")
        given = session(master, **{"spark.checkpoint.dir": "hdfs://host/shared/"})
        assert shared.shared_dir(given, "t").startswith("hdfs://host/shared/t-")
    for master in ("local", "local[4]", "local[*]"):
        alone = session(master)
        first, second = (shared.shared_dir(alone, "t").rsplit("/", 1)[0] for _ in range(2))
        assert first == second == alone.conf["spark.checkpoint.dir"]


def test_released_tables_are_gone(spark):
    kept, gone = (shared.stored(spark.range(5), "test") for _ in range(2))
    shared.release(gone)
    assert kept.count() == 5
    system, path = shared.filesystem(gone._stored_at)
    assert system.get_file_info(path).type.name == "NotFound"
