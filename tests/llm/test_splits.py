import random

import pytest

from pyspark.sql import functions as F

from weftline.functions import names
from weftline.llm.related_splits import assign_splits, broken_groups, record_groups, split_report

STRESS = "raw_id BIGINT, record_id STRING, snapshot_id STRING, split STRING, author STRING, site STRING, group_id INT"
FLAGS = "raw_id BIGINT, hostname STRING, href STRING, split STRING, author STRING"


def test_groups_split_and_house_bylines(spark):
    stress = spark.createDataFrame(
        [
            (1, "r", None, "train", "By ANNA  Berg", "x", 1), (2, "r", None, " Test", "berg, anna", "x", 1), (3, "r", None, "train", "Staff", "x", 1), (4, "r", None, "test", "The Newsroom", "x", 1),
            (5, "r", None, None, "Anna Berg", "x", 1), (6, "r", None, "validation", None, "x", 1), (6, "r", None, "validation", None, "x", 1), (None, "r", None, "test", "Anna Berg", "x", 1), (7, "r", None, "TRAIN", None, "x", 1), (8, "r", None, "test", "", "x", 1),
        ],
        STRESS,
    )
    flags = spark.createDataFrame(
        [
            (1, "a.test", None, "s", "z"), (2, "WWW.B.test:80", None, "s", "z"), (3, "c.test", None, "s", "z"), (4, "d.test", None, "s", "z"), (5, None, "https://e.test/p", "s", "z"),
            (6, " E.TEST. ", None, "s", "z"), (6, " E.TEST. ", None, "s", "z"), (7, None, None, "s", "z"), (8, None, None, "s", "z"),
        ],
        FLAGS,
    )
    groups = record_groups(spark, stress, flags)
    rows = {r.raw_id: r for r in groups.collect()}
    assert len(rows) == groups.count() == 8
    assert len({rows[i].group_id for i in (1, 2, 5, 6)}) == 1
    assert len({rows[i].group_id for i in (1, 3, 4, 7, 8)}) == 5
    assert rows[5].split is None and rows[2].split == "test"
    assert {r.raw_id for r in broken_groups(groups).collect()} == {1, 2, 6}
    new = assign_splits(groups, {"train": 0.8, "validation": 0.1, "test": 0.1})
    assert new.count() == 8
    assert new.groupBy("group_id").agg(F.countDistinct("split").alias("n")).where("n > 1").isEmpty()
    assert {r.split for r in split_report(groups, new).collect()} <= {"train", "validation", "test"}


def test_no_records(spark):
    groups = record_groups(spark, spark.createDataFrame([], STRESS), spark.createDataFrame([], FLAGS))
    assert groups.isEmpty() and broken_groups(groups).isEmpty()
    assert assign_splits(groups, {"train": 1.0}).isEmpty()


def test_shares_are_near_with_a_hot_site(spark):
    n = 3000
    stress = spark.createDataFrame([(i, "r", None, "train", f"Author N{i % 900}", "x", 1) for i in range(n)], STRESS)
    flags = spark.createDataFrame([(i, "hot.test" if i % 9 == 0 else f"s{i % 900}.test", None, "x", "y") for i in range(n)], FLAGS)
    groups = record_groups(spark, stress, flags)
    shares = {r.split: r.share for r in split_report(groups, assign_splits(groups, {"train": 0.8, "validation": 0.1, "test": 0.1})).collect()}
    assert abs(shares["train"] - 0.8) < 0.03 and abs(shares["test"] - 0.1) < 0.03


@pytest.mark.parametrize(
    ("host", "href", "want"),
    [("WWW.A.Test.", None, "a.test"), (" a.test:8080 ", None, "a.test"), (None, "https://user@B.test:1/x?y#z", "b.test"), ("", "http://c.test", "c.test"), (None, None, None), ("help.a.test", None, "help.a.test"), (None, "no address", None)],
)
def test_sites(spark, host, href, want):
    df = spark.createDataFrame([(host, href)], "h STRING, u STRING")
    assert df.select(names.site(F.col("h"), F.col("u")).alias("s")).collect()[0].s == want
