import glob

import pytest

from seqloom.session import drop, shared_dir, table


def test_tables_are_written_read_and_dropped(spark):
    t = table(spark.range(5), "five")
    files = f"{shared_dir(spark)}/tables/five-*"
    assert t.count() == 5 and len(glob.glob(files)) == 1
    drop(t, spark.range(3))
    assert not glob.glob(files)


def test_a_cluster_must_name_a_shared_folder():
    class Session:
        conf = {}
        sparkContext = type("Context", (), {"master": "spark://somewhere:7077"})

    with pytest.raises(ValueError, match="checkpoint"):
        shared_dir(Session())
