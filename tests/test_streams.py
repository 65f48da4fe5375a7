"""Tables read as streams."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from labelmill.plans.loop_queries import _stream
from labelmill.streaming import live


@pytest.mark.parametrize("files", [0, 1, 3])
def test_a_table_is_streamed_from_a_file_or_a_folder(spark, tmp_path, files):
    """``files`` is 0 for one file, else the number of files in a folder; other tables stay out."""
    sf = tmp_path / "sf"
    sf.mkdir()
    pq.write_table(pa.table({"conv_id": [7, 8]}), sf / "other.parquet")
    if files:
        spark.range(6).withColumnRenamed("id", "conv_id").repartition(files).write.parquet(str(sf / "conversations.parquet"))
    else:
        pq.write_table(pa.table({"conv_id": list(range(6))}), sf / "conversations.parquet")
    out = str(tmp_path / "out")
    live.append_stream(_stream(spark, str(sf), "conversations"), out, str(tmp_path / "ck")).awaitTermination()
    assert sorted(r.conv_id for r in spark.read.parquet(out).collect()) == list(range(6))
