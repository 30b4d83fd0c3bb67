"""Components that haven't settled are an error."""

import pytest

from schemaloom.llm.components import components


def test_unsettled_components_raise(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(20)], "a long, b long")
    with pytest.raises(RuntimeError, match="still change after 1 round"):
        components(chain, max_rounds=1)


def test_chains_that_still_grow_are_an_error(spark, tmp_path):
    from schemaloom.llm import warc

    line = warc.MAGIC + b"WARC-Type: response\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(line * 200)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        with pytest.raises(RuntimeError, match="still grow"):
            warc.read_warc(spark, str(tmp_path), max_rounds=1)
        assert warc.read_warc(spark, str(tmp_path)).where("complete").count() == 200
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
