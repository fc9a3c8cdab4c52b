import os
import time

import pytest

from lagloom import sources


@pytest.mark.parametrize("suffix", ["parquet", "orc", "json", "csv"])
def test_round_trip(spark, tmp_path, suffix):
    df = spark.createDataFrame([(1, "a", 2.5), (2, None, None)], "id long, s string, x double")
    path = str(tmp_path / f"t.{suffix}")
    sources.export(df, path)
    back = sources.load(spark, path, schema=df.schema)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_export_partitioned_and_unknown_suffix(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, s string")
    path = str(tmp_path / "p.parquet")
    sources.export(df, path, partition_by=["s"])
    assert os.path.isdir(os.path.join(path, "s=a"))
    with pytest.raises(ValueError):
        sources.export(df, str(tmp_path / "t.xlsx"))
    with pytest.raises(ValueError):
        sources.load(spark, "t.xlsx")


def test_newest_file(spark, tmp_path):
    for i, name in enumerate(["b", "a", "c"]):
        p = tmp_path / f"{name}.csv"
        p.write_text(f"k,v\n{name},{i}\n")
        os.utime(p, (time.time() - 100 + (50 if name == "a" else i),) * 2)
    df = sources.load_newest(spark, str(tmp_path), fmt="csv")
    assert [tuple(r) for r in df.collect()] == [("a", "1")]
    # Files of one write share a time: all are read, in one load.
    os.utime(tmp_path / "c.csv", (os.path.getmtime(tmp_path / "a.csv"),) * 2)
    df = sources.load_newest(spark, str(tmp_path))
    assert sorted(tuple(r) for r in df.collect()) == [("a", "1"), ("c", "2")]


def test_banner_lines_are_skipped_per_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Report 2020\n,,\nid,name\n1,x\n2,y\n\n")
    (tmp_path / "b.csv").write_text("id,name\n3,z\n")
    df = sources.load_with_banner(spark, str(tmp_path), r"^id,", "id long, name string")
    assert sorted(map(tuple, df.collect())) == [(1, "x"), (2, "y"), (3, "z")]


def test_banner_keeps_rows_like_the_header_and_names_files_without_one(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Title\nid,name\n1,x\nid,again\n2,y\n")
    rows = sources.load_with_banner(spark, str(tmp_path), r"^id,", "id long, name string").collect()
    assert sorted(map(tuple, rows), key=repr) == [(1, "x"), (2, "y"), (None, "again")]
    (tmp_path / "b.csv").write_text("3,z\n")
    with pytest.raises(Exception, match="no header line"):
        sources.load_with_banner(spark, str(tmp_path), r"^id,", "id long, name string").collect()


def test_manual_rows_need_a_key(spark):
    df = sources.manual_rows(spark, [("s1", 2014), ("s2", 1998)], "study string, year int", "study")
    assert df.count() == 2
    for bad in ([("s1", 1), ("s1", 2)], [(None, 1)]):
        with pytest.raises(ValueError):
            sources.manual_rows(spark, bad, "study string, year int", "study")


def test_named_table(spark):
    assert sources.load_named(spark, "/root/testdata/sf0.001", "region").count() == 5
