import pytest

from codexmill import session


def test_scratch_is_dropped(spark):
    df = session.written(spark.range(5), "numbers")
    assert df.count() == 5
    session.drop_scratch(spark)
    with pytest.raises(Exception):
        df.count()


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return self

        def get(self, *_):
            return None

    class Session:
        sparkContext = Context()
        conf = Context()

    with pytest.raises(RuntimeError):
        session.shared_dir(Session())
