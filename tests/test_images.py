"""Image files: names, versions, the manifest as batch and stream, the extension rule."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from catalytics.sources import images as IM
from helpers import rows


def store(spark, folder, data):
    IM.write_images(spark.createDataFrame(data, "asin long, version long, body string"), folder)


def test_newest_version_wins_and_old_ones_stay(spark, tmp_path):
    folder = f"{tmp_path}/images"
    store(spark, folder, [(1, 0, "one"), (2, 0, "two"), (12, 0, "twelve")])
    store(spark, folder, [(1, 2, "one again"), (1, 1, "one later"), (12, 10, "ten")])
    files = rows(IM.read_images(spark, folder))
    assert len(files) == 6 and {r["length"] for r in files if r["asin"] == 2} == {len("two\n")}
    got = {r["asin"]: r for r in rows(IM.manifest(IM.read_images(spark, folder)))}
    assert {a: (r["version"], r["versions"]) for a, r in got.items()} == {1: (2, 3), 2: (0, 1), 12: (10, 2)}
    sha = rows(spark.range(1).select(F.sha2(F.lit("one again\n"), 256).alias("h")))[0]["h"]
    assert got[1]["sha256"] == sha
    catalog = spark.createDataFrame([(1,), (2,), (5,)], "asin long")
    assert [r["asin"] for r in rows(IM.missing_images(catalog, IM.read_images(spark, folder)))] == [5]


def test_stream_of_new_files_equals_the_scan(spark, tmp_path):
    folder, sink, state = (f"{tmp_path}/{n}" for n in ("images", "sink", "state"))
    for data in ([(k, 0, f"image {k}") for k in range(6)], [(3, 1, "new"), (9, 0, "late")], [(3, 2, "newer")]):
        store(spark, folder, data)
        IM.start_manifest(spark, folder, sink, state).awaitTermination()
    key = lambda d: sorted(tuple(sorted(r.items())) for r in rows(d))
    assert key(IM.read_manifest(spark, sink)) == key(IM.manifest(IM.read_images(spark, folder)))


def test_a_stream_needs_no_task_per_file(spark, tmp_path):
    """New files are listed by folder: listing jobs of a task per file take longer than the reading."""
    folder, sink, state = (f"{tmp_path}/{n}" for n in ("images", "sink", "state"))
    n, tracker = 400, spark.sparkContext.statusTracker()
    for version in (0, 1):
        store(spark, folder, [(k, version, f"image {k}") for k in range(n)])
        run = IM.start_manifest(spark, folder, sink, state)
        run.awaitTermination()
        stages = [s for j in tracker.getJobIdsForGroup(str(run.runId)) for s in tracker.getJobInfo(j).stageIds]
        tasks = [i.numTasks for i in map(tracker.getStageInfo, stages) if i]
        assert tasks and max(tasks) <= max(IM.SHARES, 8)
    assert {(r["version"], r["versions"]) for r in rows(IM.read_manifest(spark, sink))} == {(1, 2)}


def test_a_stream_meets_the_files_that_a_scan_meets(spark, tmp_path):
    folder, sink, state = (f"{tmp_path}/{n}" for n in ("images", "sink", "state"))
    key = lambda d: sorted((tuple(sorted(r.items())) for r in rows(d)), key=str)

    def put(name, body):
        file = tmp_path / "images" / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(body)

    def run():
        IM.start_manifest(spark, folder, sink, state).awaitTermination()
        found = key(IM.read_manifest(spark, sink))
        assert found == key(IM.manifest(IM.read_images(spark, folder)))
        return {dict(r)["asin"]: (dict(r)["version"], dict(r)["versions"], dict(r)["length"]) for r in found}

    store(spark, folder, [])
    assert run() == {}
    put("part-1.0-a.txt", b"in the folder itself")
    put("image=2.0/part-00000-b.txt", b"older layout")
    put("deep/er/_k=1/part-3.0-c.txt", b"deep")
    put("share=0/part-5.1-a.txt", b"")
    put("share=0/part-4.0-a b%20.txt", bytes(range(256)) * 10_000)
    put("share=0/part-none.txt", b"no key")
    for name in ("_temporary/0/image=5.0/part-0.txt", ".hidden/part-5.0-a.txt", "share=0/_part-5.0-a.txt", "share=0/5.0.txt", "share=0/part-5.0-a._COPYING_"):
        put(name, b"not to be met")
    assert run() == {None: (None, 1, 6), 1: (0, 1, 20), 2: (0, 1, 12), 3: (0, 1, 4), 4: (0, 1, 2_560_000)}
    assert run()[4] == (0, 1, 2_560_000)                 # nothing new
    put("share=0/part-4.2-a.txt", b"newer")
    put("image=2.1/part-00000-b.txt", b"new folder")
    assert {a: v for a, v in run().items() if a in (2, 4)} == {2: (1, 2, 10), 4: (2, 2, 5)}


def test_a_stream_without_its_folder_fails_at_once(spark, tmp_path):
    with pytest.raises((FileNotFoundError, AnalysisException)):
        IM.start_manifest(spark, f"{tmp_path}/none", f"{tmp_path}/sink", f"{tmp_path}/state")


def test_a_file_system_that_only_spark_knows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(IM, "_arrow_folder", lambda spark, folder: None)
    test_stream_of_new_files_equals_the_scan(spark, tmp_path)


def test_upload_names_and_extensions(spark):
    names = ["a.jpg", "a.JPEG", "x.y.png", "b.webp", "c.gif", "noext", ".jpg", "d.jpg.exe", "e.", None]
    df = spark.createDataFrame([(k, "Ann.Bee@x.com ", None, n) for k, n in enumerate(names)], "id long, owner_email string, ts timestamp, filename string")
    got = {r["id"]: r for r in rows(IM.upload_requests(df))}
    assert [got[k]["image_filename"] for k in range(4)] == ["up_Ann.Bee_0.jpg", "up_Ann.Bee_1.jpeg", "up_Ann.Bee_2.png", "up_Ann.Bee_3.webp"]
    assert [got[k]["content_type"] for k in range(4)] == ["image/jpeg", "image/jpeg", "image/png", "image/webp"]
    assert all(got[k]["reject_reason"] == IM.BAD_EXTENSION and got[k]["image_filename"] is None for k in range(4, 10))
    kept, dropped = IM.split_uploads(df)
    assert kept.count() == 4 and dropped.count() == 6


def test_images_are_written_by_many_tasks_into_few_folders(spark, tmp_path):
    """Files cost time by their number, not their bytes: many tasks write them, and a listing meets one folder per share."""
    import os
    folder, n = f"{tmp_path}/images", 600
    store(spark, folder, [(k, 0, f"image {k}") for k in range(n)] + [(7, 0, "twice"), (8, 0, None), (None, 0, "no key")])
    store(spark, folder, [(5, 1, "newer"), (6, 0, "same version again")])
    store(spark, folder, [])
    shares = [d for d in os.listdir(folder) if d.startswith("share=")]
    assert 8 < len(shares) <= IM.SHARES and not [f for d in shares for f in os.listdir(f"{folder}/{d}") if not f.startswith("part-")]
    files = rows(IM.read_images(spark, folder))
    assert len(files) == n + 3 and sum(r["asin"] is None for r in files) == 1
    got = {r["asin"]: r for r in rows(IM.manifest(IM.read_images(spark, folder)))}
    assert (got[5]["version"], got[5]["versions"], got[6]["version"], got[6]["versions"], got[7]["versions"]) == (1, 2, 0, 2, 1)
    assert got[7]["length"] == len("image 7\ntwice\n") and got[8]["length"] == len("\nimage 8\n")


def test_an_empty_set_and_the_older_layout_are_read(spark, tmp_path):
    folder = f"{tmp_path}/images"
    store(spark, folder, [])
    assert rows(IM.read_images(spark, folder)) == []
    spark.createDataFrame([("3.1", "old")], "image string, value string").write.mode("append").partitionBy("image").text(folder)
    store(spark, folder, [(3, 2, "new")])
    assert sorted((r["asin"], r["version"]) for r in rows(IM.read_images(spark, folder))) == [(3, 1), (3, 2)]
