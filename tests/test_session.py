"""The library leaves a running session's settings alone and needs a named checkpoint folder."""

import pytest

from vulnscan import session


def test_running_session_is_unchanged(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    got = session.get_spark("other", spark__sql__shuffle__partitions=77, spark__master="local[2]")
    assert got is spark and {k: spark.conf.get(k) for k in before} == before


class _NoFolder:
    """A session without checkpoint folder."""

    class sparkContext:
        master = "spark://host:7077"

        @staticmethod
        def getCheckpointDir():
            return None

        @staticmethod
        def getConf():
            return {}

        @staticmethod
        def setCheckpointDir(path):
            raise AssertionError(f"set {path}")

    class conf:
        @staticmethod
        def get(key, default=None):
            return default


def test_missing_checkpoint_folder_raises():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_root(_NoFolder)
    session.local_checkpoint_dir(_NoFolder)  # nothing on a cluster
    _NoFolder.sparkContext.master = "local-cluster[2,1,1024]"
    session.local_checkpoint_dir(_NoFolder)


def test_rows_that_grow_keep_their_parts(spark, tmp_path):
    """AQE does not join the parts of short rows of which many are made."""
    from vulnscan.operators.methods import co_partition
    from vulnscan.plans import fixtures as fx

    docs = spark.createDataFrame([(i, f"a b\nc {i}", "en", "web", 7) for i in range(50)], "doc_id long, text string, lang string, source string, n_chars int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    parts = session.GROWING_PARTS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert fx.tokens(spark, str(tmp_path)).rdd.getNumPartitions() == parts
    assert fx.code_files(spark, str(tmp_path), spread=True).rdd.getNumPartitions() == parts
    assert co_partition(fx.code_files(spark, str(tmp_path))).rdd.getNumPartitions() == parts


def test_parts_follow_the_bytes_of_the_texts(spark, monkeypatch):
    """a task's memory does not grow with the input, since the parts do."""
    from vulnscan.operators.methods import co_partition

    monkeypatch.setattr(session, "PART_BYTES", 100)
    least = session.GROWING_PARTS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    df = spark.createDataFrame([(i, "x" * 100) for i in range(3 * least)] + [(-1, None)], "doc_id long, code string")
    assert session.by_key(df, "doc_id", text="code").rdd.getNumPartitions() == 3 * least
    assert co_partition(df).rdd.getNumPartitions() == 3 * least
    assert session.by_key(df.filter("code is null"), "doc_id", text="code").rdd.getNumPartitions() == least
