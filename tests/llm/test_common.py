import os

import pyarrow as pa
import pytest

from rankloom.llm import common


def test_staged_tables_go_with_their_block(spark):
    with common.staging(spark):
        df = common.staged(spark.createDataFrame([(1, None), (2, "x")], "a int, b string"), "test")
        path = common._owners[-1][-1]
        assert path.startswith(common.shared_dir(spark))
        assert sorted(r.a for r in df.collect()) == [1, 2]
        assert os.path.exists(path.removeprefix("file://"))
        mark = common.tables_mark()
        common.staged(spark.range(3), "other")
        assert len(common.tables_since(mark)) == 1
        common.drop_tables(spark, common.tables_since(mark))
        assert common._owners[-1] == [path]
    assert not os.path.exists(path.removeprefix("file://"))


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Cluster:
        conf = Conf()

        class sparkContext:
            master = "spark://host:7077"
            getConf = staticmethod(Conf)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Cluster())


def test_slices_of_batches():
    batch = pa.RecordBatch.from_arrays([pa.array(range(10))], names=["a"])
    got = list(common.sliced([batch, batch.slice(0, 0)], 4))
    assert [b.num_rows for b in got] == [4, 4, 2]
    assert [x for b in got for x in b.column(0).to_pylist()] == list(range(10))
