"""Frames written and read, whole and broken, as a batch and as a stream."""

import os

import pytest
from pyspark.sql import functions as F

from textloom.sources import frames


@pytest.fixture(scope="module", autouse=True)
def source(spark):
    spark.dataSource.register(frames.FrameSource)


def frame(raw):
    return len(raw).to_bytes(4, "little") + raw


def test_round_trip_of_a_table(spark, small, tmp_path):
    rows = spark.read.parquet(f"{small}/conversations.parquet").select(F.encode(F.to_json(F.struct("conv_id", "turn", "role", "text")), "UTF-8").alias("payload"))
    for folder in (str(tmp_path / "a"), (tmp_path / "b").as_uri()):
        rows.repartition(3).write.format("frames").mode("append").save(folder)
        one = spark.read.format("frames").load(folder)
        many = spark.read.format("frames").option("splitBytes", 500).load(folder)
        assert one.rdd.getNumPartitions() == 3 < 20 < many.rdd.getNumPartitions()
        for df in (one, many):
            assert sorted(bytes(r.payload) for r in df.collect()) == sorted(bytes(r.payload) for r in rows.collect())
    assert not [f for f in os.listdir(tmp_path / "a") if not f.endswith(frames.SUFFIX)]


def test_empty_payloads_files_and_folders(spark, tmp_path):
    (tmp_path / "x.frames").write_bytes(frame(b"") + frame(b"a") + frame(b""))
    (tmp_path / "empty.frames").write_bytes(b"")
    (tmp_path / "other.txt").write_bytes(b"not frames")
    got = [(r.at, bytes(r.payload)) for r in spark.read.format("frames").load(str(tmp_path)).orderBy("at").collect()]
    assert got == [(0, b""), (4, b"a"), (9, b"")]
    assert spark.read.format("frames").load(str(tmp_path / "nowhere")).count() == 0
    spark.createDataFrame([], "payload binary").write.format("frames").mode("append").save(str(tmp_path / "none"))
    assert spark.read.format("frames").load(str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize(("raw", "says"), [(frame(b"ok") + b"\x05\0\0\0abc", "isn't whole"), (frame(b"ok") + b"\x05\0", "isn't whole"), (frame(b"ok") + (frames.MOST + 1).to_bytes(4, "little") + b"x", "too large")])
def test_broken_frames_are_named(spark, tmp_path, raw, says):
    (tmp_path / "bad.frames").write_bytes(raw)
    with pytest.raises(Exception, match=f"bad.frames.*{says}|{says}"):
        spark.read.format("frames").load(str(tmp_path)).collect()


def test_oversized_payloads_are_refused(spark, tmp_path):
    rows = spark.range(2).select(F.when(F.col("id") == 0, F.lit(b"small")).otherwise(F.encode(F.repeat(F.lit("x"), frames.MOST + 1), "UTF-8")).alias("payload"))
    with pytest.raises(Exception, match="too large"):
        rows.coalesce(1).write.format("frames").mode("append").save(str(tmp_path / "big"))
    assert not os.path.exists(tmp_path / "big") or os.listdir(tmp_path / "big") == []


def test_stream_of_growing_files(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.frames").write_bytes(frame(b"1") + frame(b"2"))

    def run():
        df = spark.readStream.format("frames").option("splitBytes", 5).load(str(folder)).select(F.col("payload").cast("string").alias("p"))
        q = df.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(r.p for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == ["1", "2"]
    with open(folder / "a.frames", "ab") as f:
        f.write(frame(b"3"))
    (folder / "b.frames").write_bytes(frame(b"4"))
    assert run() == ["1", "2", "3", "4"]
