"""Tables that are written on the way."""

import os

from tessel import storage


def test_release_and_sweep(spark):
    storage.release(spark)
    folder = storage.shared_dir(spark).removeprefix("file://")
    df = storage.written(spark.range(5), "mine")
    kept = storage.kept_on_disk(spark.range(3))
    assert df.count() == 5 and kept.count() == 3 and kept.is_cached
    os.makedirs(f"{folder}/tessel-left-by-another")
    os.makedirs(f"{folder}/something-else")
    assert storage.sweep(spark, 3600) == 0
    assert storage.sweep(spark, -60) == 1 and df.count() == 5
    storage.release(spark)
    assert not any(n.startswith("tessel-") for n in os.listdir(folder)) and "something-else" in os.listdir(folder) and not kept.is_cached
    os.rmdir(f"{folder}/something-else")


def test_folder_where_none_is_set():
    path = storage._temporary()
    assert path.startswith("file:///") and storage._temporary() == path and os.path.isdir(path.removeprefix("file://"))
