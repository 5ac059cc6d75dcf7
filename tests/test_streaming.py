import datetime

from cairn.sources.catalog import schema
from cairn.streaming import decisions


def test_leaves_of_a_growing_log(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    row = lambda d, before, action: (d, "s1", None, None, "r", action, at, "", "v", "rel", before)
    source, target, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    for rows, want in (([row("d1", None, "defer")], {"d1"}), ([row("d2", "d1", "accept"), row("d3", None, "reject")], {"d2", "d3"})):
        spark.createDataFrame(rows, schema("review_decisions")).write.mode("append").parquet(source)
        q = decisions.follow(spark, source, target, mark)
        q.awaitTermination(120)
        assert {r["decision_id"] for r in decisions.current(spark, target).collect()} == want
