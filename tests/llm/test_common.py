import re
from pathlib import Path
from types import SimpleNamespace

import pyarrow as pa
import pytest

from cairn.llm import common


def test_a_cluster_needs_a_shared_folder(spark):
    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        common.scratch_root(cluster)
    given = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: "hdfs://host/scratch/"))
    assert common.scratch_root(given) == "hdfs://host/scratch"
    assert common.scratch_root(spark) == common.scratch_root(spark) != ""


def test_scratch_tables_come_and_go(spark):
    table = common.materialize(spark.range(5), "some")
    assert table.count() == 5
    common.discard(table)
    with pytest.raises(Exception):  # noqa: B017
        spark.read.parquet(table._scratch_path).count()


def test_slots_without_groups_are_bounded_and_cover_all(spark):
    df = spark.range(500).withColumnRenamed("id", "doc_id")
    assert 1 <= common.slot_sample(df, 16).count() <= 16
    assert common.slot_sample(df, 1 << 20).count() == 500
    assert common.slot_sample(df.where("doc_id < 0"), 16).count() == 0


def test_a_worker_gives_memory_back_after_a_task(spark):
    """What a step frees is not kept by the C library: blocks with a used one after them, as between long-lived objects."""

    def held():
        return sum(int(x) for x in re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())) / 1024

    kept = []

    def compute(part):
        many = [b"x" * 20_000 for _ in range(6000)]
        kept.extend(many[::100])
        return [[len(many)] * part.num_rows]

    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    step = common.add_columns(SimpleNamespace(schema=df.schema, sparkSession=spark, mapInArrow=lambda run, _: run), "n long", compute, ["doc_id"])
    before = held()
    out = list(step([pa.RecordBatch.from_pylist([{"doc_id": 1, "text": "a"}])]))
    assert out[0].to_pylist() == [{"doc_id": 1, "n": 6000}]
    assert held() - before < 40
