"""The shared folder, clashing names, and the bound of what is broadcast."""

import pytest

from loamstack.llm import common


def test_a_cluster_without_a_shared_folder_is_an_error(monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    for master in ("spark://host:7077", "local-cluster[3,2,3000]", "yarn"):
        Context.master = master
        with pytest.raises(ValueError, match="all executors share"):
            common.shared_dir(Session())


def test_needed_columns_keep_their_names(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "`a.b` int, Text int, text int, c_0 int")
    assert common.plain(df, "text").columns == ["c_0", "c_1", "text", "c_3"]
    assert common.plain(spark.createDataFrame([(1,)], "Text int"), "text").columns == ["text"]
    with pytest.raises(ValueError, match="no column text"):
        common.plain(spark.createDataFrame([(1,)], "other int"), "text")


@pytest.mark.parametrize("n", [0, 1, 50_000])
def test_maybe_in_flags_all_and_sends_a_bounded_table(spark, n):
    docs = spark.range(-10, 60_000).select("id").withColumnRenamed("id", "doc_id")
    flagged = common.maybe_in(docs, spark.range(n).toDF("x"))
    found = {r["doc_id"] for r in flagged.where("__maybe").collect()}
    assert set(range(n)) <= found and len(found) < n + 200
    words = common.bitmap(spark.range(n).toDF("x"))
    assert words.count() <= common.BITMAP_BITS // 32768
    assert all(len(r["__bits"]) == 4096 for r in words.limit(3).collect())


def test_discarded_tables_are_gone(spark):
    kept, gone = common.cut(spark.range(5), "kept"), common.cut(spark.range(5), "gone")
    common.discard(gone)
    assert kept.count() == 5
    with pytest.raises(Exception):  # noqa: B017
        gone.collect()
