import json
import tempfile

from sparqa.sources import fixtures
from sparqa.sources.manifest import read_manifest
from sparqa.sources.sinks import materialise_once, preview
from sparqa.streaming.curate import curate_stream
from sparqa.operators import curate

from conftest import SF_SMALL


def test_manifest(spark):
    d = tempfile.mkdtemp(prefix="sparqa-test-")
    path = f"{d}/m.json"
    with open(path, "w") as f:
        json.dump({"a_dataset_repo_id": "x/1", "b_dataset_repo_id": "y/2"}, f, indent=2)
    got = sorted(map(tuple, read_manifest(spark, path).collect()))
    assert got == [("a", "x/1"), ("b", "y/2")]


def test_materialise_once_reuses_complete_builds(spark):
    d = tempfile.mkdtemp(prefix="sparqa-test-")
    calls = []

    def build():
        calls.append(1)
        return spark.range(5)

    a = materialise_once(spark, d, build, {"v": 1})
    b = materialise_once(spark, d, build, {"v": 1})
    c = materialise_once(spark, d, build, {"v": 2})
    assert a.count() == b.count() == c.count() == 5 and len(calls) == 2


def test_preview_orders_by_row_id(spark):
    df = spark.createDataFrame([(3,), (1,), (2,)], "row_id long")
    assert [r.row_id for r in preview(df, 2).collect()] == [1, 2]


def test_stream_equals_batch(spark):
    d = tempfile.mkdtemp(prefix="sparqa-test-")
    src = fixtures.fourcol_source(spark, SF_SMALL)
    src.repartition(3).write.parquet(f"{d}/in")
    q = curate_stream(spark, "fourcol", f"{d}/in", src.schema, f"{d}/out", checkpoint=f"{d}/ckpt",
                      max_files_per_trigger=1)
    q.awaitTermination(300)
    got = sorted(map(tuple, spark.read.parquet(f"{d}/out").collect()))
    want = sorted(map(tuple, curate.curate_fourcol(src).collect()))
    assert got == want and len(got) > 0


def test_stream_resumes_from_checkpoint_without_duplicates(spark):
    d = tempfile.mkdtemp(prefix="sparqa-test-")
    src = fixtures.fourcol_source(spark, SF_SMALL)
    a = src.where("c_custkey % 2 = 0")
    b = src.where("c_custkey % 2 = 1")
    a.write.parquet(f"{d}/in/part-a")
    curate_stream(spark, "fourcol", f"{d}/in/part-a", src.schema, f"{d}/out",
                  checkpoint=f"{d}/ckpt").awaitTermination(300)
    first = spark.read.parquet(f"{d}/out").count()
    # a restart with the same checkpoint re-reads nothing it already committed
    curate_stream(spark, "fourcol", f"{d}/in/part-a", src.schema, f"{d}/out",
                  checkpoint=f"{d}/ckpt").awaitTermination(300)
    assert spark.read.parquet(f"{d}/out").count() == first
    # new files arriving later are picked up by the next run
    b.write.parquet(f"{d}/in2")
    import shutil
    for f in __import__("glob").glob(f"{d}/in2/*.parquet"):
        shutil.copy(f, f"{d}/in/part-a/")
    curate_stream(spark, "fourcol", f"{d}/in/part-a", src.schema, f"{d}/out",
                  checkpoint=f"{d}/ckpt").awaitTermination(300)
    got = sorted(r.row_id for r in spark.read.parquet(f"{d}/out").collect())
    want = sorted(r.row_id for r in curate.curate_fourcol(src).collect())
    assert got == want


def test_build_once_follows_its_input(spark, tmp_path):
    from sparqa.sources.sinks import input_fingerprint, materialise_once

    root, base = str(tmp_path / "in"), str(tmp_path / "cache")

    def built():
        return materialise_once(spark, base, lambda: spark.read.parquet(root), {"input": input_fingerprint(spark, root)}).count()

    spark.range(10).write.parquet(root)
    assert built() == 10
    spark.range(7).write.mode("overwrite").parquet(root)
    assert built() == 7
