"""Connected components by both ways, against union-find."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from barograph.llm import jaccard_join

CASES = {
    "random": [(int(a), int(b)) for a, b in np.random.default_rng(3).integers(-50, 400, (300, 2))],
    "path": [(i, i + 1) for i in range(20)],
    "star of smaller ids": [(900, i) for i in range(60)],
    "both ways, to itself": [(7, 3), (3, 7), (5, 5), (2**62, -(2**62))],
    "none": [],
}


def smallest(edges):
    at = {i: i for e in edges for i in e if e[0] != e[1]}
    for _ in at:
        for a, b in edges:
            if a != b:
                at[a] = at[b] = min(at[a], at[b])
    return {i: m for i, m in at.items() if m < i}


@pytest.mark.parametrize("few", [jaccard_join.FEW_LINKS, -1])
@pytest.mark.parametrize("case", [c for c in CASES if c != "none"])
def test_components_equal_union_find(spark, case, few):
    edges = spark.createDataFrame(CASES[case], "x long, y long")
    assert {r.doc_id: r.component for r in jaccard_join.components(edges, few=few).collect()} == smallest(CASES[case])


def test_least_ids_of_no_link():
    ids, least = jaccard_join.least_ids(np.empty(0, np.int64), np.empty(0, np.int64))
    assert len(ids) == len(least) == 0


def test_few_links_take_few_jobs(spark):
    """Near copies dealt over many partitions: the jobs on their links must not outnumber the search's own."""
    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(80)), lambda k: F.concat(F.lit("w"), F.when(k == F.col("id") % 80, F.col("id")).otherwise(k).cast("string"))))
    docs = spark.range(40).select(F.col("id").alias("doc_id"), text.alias("text"))
    tracker, group = spark.sparkContext.statusTracker(), "few-links"
    spark.sparkContext.setJobGroup(group, group)
    try:
        jaccard_join.components(spark.createDataFrame([(i, i + 1) for i in range(100)], "x long, y long"))
        jobs = len(tracker.getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 5
    assert jaccard_join.jaccard_groups(docs, 4, 85, 100).select("component_id").distinct().count() == 1
