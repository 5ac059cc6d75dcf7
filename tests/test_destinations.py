import os

import pytest

from cairn.sources import destinations as d


@pytest.fixture
def source(tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.json").write_text("keep")
    return tmp_path


def _refused(spark, destination, source):
    with pytest.raises(d.UnsafeDestination):
        d.publish_text(spark, str(destination), "new", {"input": str(source / "in" / "a.json"), "tree": str(source / "in" / "deep")})
    assert (source / "in" / "a.json").read_text() == "keep"


def test_same_file_by_other_names(spark, source):
    _refused(spark, source / "in" / "a.json", source)
    _refused(spark, source / "in" / "deep" / ".." / "a.json", source)
    _refused(spark, f"file://{source}/in/a.json", source)


def test_links(spark, source):
    os.symlink(source / "in" / "a.json", source / "soft.json")
    os.link(source / "in" / "a.json", source / "hard.json")
    os.symlink(source / "in", source / "folder")
    for name in ("soft.json", "hard.json", "folder/a.json", "folder/deep/new.json"):
        _refused(spark, source / name, source)


def test_inside_and_above(spark, source):
    _refused(spark, source / "in" / "deep" / "later" / "x.json", source)
    _refused(spark, source / "in", source)
    assert d.publish_text(spark, str(source / "in" / "deeper.json"), "ok", {"tree": str(source / "in" / "deep")})
    assert (source / "in" / "deeper.json").read_text() == "ok"


def test_no_clobber_and_replace(spark, tmp_path):
    target = str(tmp_path / "out" / "x.txt")
    d.publish_text(spark, target, "één", replace=False)
    with pytest.raises(FileExistsError):
        d.publish_text(spark, target, "two", replace=False)
    assert open(target, encoding="utf-8").read() == "één"
    d.publish_text(spark, target, "two")
    assert open(target).read() == "two" and [n for n in os.listdir(tmp_path / "out") if "building" in n] == []


def test_a_writer_that_loses_the_race(spark, tmp_path):
    """Another writer takes the name while this one works."""
    target = tmp_path / "x.txt"

    def write(draft):
        with open(draft.removeprefix("file:"), "w") as f:
            f.write("mine")
        target.write_text("theirs")

    with pytest.raises(FileExistsError):
        d.publish_via(spark, str(target), write)
    assert target.read_text() == "theirs" and os.listdir(tmp_path) == ["x.txt"]


def test_a_link_that_appears_meanwhile(spark, source):
    target = source / "out.json"

    def write(draft):
        with open(draft.removeprefix("file:"), "w") as f:
            f.write("new")
        os.symlink(source / "in" / "a.json", target)

    with pytest.raises(d.UnsafeDestination):
        d.publish_via(spark, str(target), write, {"input": str(source / "in" / "a.json")}, replace=True)
    assert (source / "in" / "a.json").read_text() == "keep"


def test_folders(spark, tmp_path):
    target = str(tmp_path / "table")
    d.publish_via(spark, target, lambda p: spark.range(5).write.parquet(p))
    with pytest.raises(FileExistsError):
        d.publish_via(spark, target, lambda p: spark.range(9).write.parquet(p))
    assert spark.read.parquet(target).count() == 5
    d.publish_via(spark, target, lambda p: spark.range(7).write.parquet(p), replace=True)
    assert spark.read.parquet(target).count() == 7 and os.listdir(tmp_path) == ["table"]


def test_failed_work_leaves_nothing(spark, tmp_path):
    target = str(tmp_path / "table")
    d.publish_via(spark, target, lambda p: spark.range(5).write.parquet(p))

    def write(draft):
        spark.range(3).write.parquet(draft)
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        d.publish_via(spark, target, write, replace=True)
    assert spark.read.parquet(target).count() == 5 and os.listdir(tmp_path) == ["table"]
