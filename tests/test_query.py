import random

import pytest
from pyspark.sql import functions as F

from jobsieve.operators import query as Q
from jobsieve.operators import stats as S


def numbers(spark, values):
    return spark.createDataFrame([(v, i) for i, v in enumerate(values)], "salary string, i bigint").repartition(4)


def test_limits():
    assert Q.effective_limit(limit=7, quick=True) == 7
    assert Q.effective_limit(quick=True, auto=True) == 20
    assert Q.effective_limit(quick=True) == 15
    assert Q.effective_limit(max_rows=99) == 99 and Q.effective_limit() is None
    with pytest.raises(ValueError):
        Q.checked_limit(-1)


def test_first_rows(spark):
    df = numbers(spark, ["3", "1", "2"])
    assert Q.first_rows(df, 0, ["i"]).count() == 0
    assert [r["salary"] for r in Q.first_rows(df, 2, ["i"]).collect()] == ["3", "1"]
    assert Q.first_rows(df, None, ["i"]).count() == 3


def test_blank_salary_passes_and_words_do_not(spark):
    df = numbers(spark, ["", " ", "negotiable", "1000", "5000 SAR", "2000-3000"])
    assert sorted(r["salary"] for r in Q.min_salary(df, 2000).collect()) == ["", " ", "2000-3000", "5000 SAR"]
    assert sorted(r["salary"] for r in Q.min_salary(df, 2500, "first_number").collect()) == ["", " ", "5000 SAR"]


def test_slices_by_position_equal_the_sorted_list(spark):
    rng = random.Random(3)
    values = [rng.randint(0, 500) for _ in range(1000)]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "k int, i int").repartition(7)
    want = sorted((v, i) for i, v in enumerate(values))
    at = Q.with_position(df, ["k", "i"]).collect()
    assert [(r["k"], r["i"]) for r in sorted(at, key=lambda r: r["row_no"])] == want
    assert sorted(r["row_no"] for r in at) == list(range(1000))
    top = Q.batch(df, 500, 25, ["k", "i"]).collect()
    assert list(map(tuple, top)) == want[500:525]
    numbered = Q.with_batch_no(df, ["k", "i"], 64).groupBy("batch_no").count().collect()
    assert sorted((r["batch_no"], r["count"]) for r in numbered)[-1] == (16, 1000 - 15 * 64)


def test_long_digit_runs_keep_their_size(spark):
    df = numbers(spark, ["1500-2000 SAR, call 0512345678 or 0512345679", "9" * 60, "200", ""])
    assert Q.min_salary(df, 1000).count() == 3 and Q.min_salary(df, 1000, "first_number").count() == 3
    full = df.selectExpr("*", "'' AS contact", "'' AS email", "'No' AS is_sponsored")
    assert S.posting_counts(full).first()["jobs_with_salary"] == 3
    analysis = S.export_stats(full.selectExpr("*", "'x' AS location")).first()
    assert analysis["salary_analysis"]["count"] == analysis["job_counts"]["jobs_with_salary"] == 3
    assert S.salary_stats(full).first()["count"] == 3 and analysis["salary_analysis"]["max"] == float("9" * 60)


@pytest.mark.parametrize("values", [[5], [5, 9], [1, 2, 3], [4, 1, 3, 2], [7] * 9 + [1],
                                    [10 ** 15 + i for i in range(50)] + [3, 2 ** 40, 2 ** 21, 2 ** 42 - 1, 2 ** 62],
                                    [10 ** 25 + 7, 10 ** 25 + 9, 3 * 10 ** 40, 12, 10 ** 24 - 1], [int("9" * 60)] * 3 + [10 ** 59]])
def test_upper_median(spark, values):
    row = S.salary_stats(numbers(spark, [str(v) for v in values])).first()
    mean = (2 * sum(values) + len(values)) // (2 * len(values))
    assert tuple(row) == (len(values), *map(float, (min(values), max(values), sorted(values)[len(values) // 2], mean)))


def test_upper_median_random(spark):
    rng = random.Random(11)
    values = [rng.randint(1, 10 ** rng.randint(1, 17)) for _ in range(500)]
    assert S.salary_stats(numbers(spark, [str(v) for v in values])).first()["median"] == float(sorted(values)[250])


def test_no_salary_no_row(spark):
    assert S.salary_stats(numbers(spark, ["", "negotiable", "0"])).count() == 0


def test_top_locations_ties_by_name(spark):
    df = spark.createDataFrame([("b",), ("a",), ("",), ("",), (None,)], "location string")
    assert [tuple(r) for r in S.top_locations(df, 2).collect()] == [("Unknown", 3), ("a", 1)]


def test_query_info_counts(spark):
    df = spark.createDataFrame([("Engineer", "Riyadh", "10"), ("Cook", "riyadh north", "")], "title string, location string, salary string")
    row = Q.query_info(df, "ENGINEER", "riyadh", None, 0).first()
    assert (row["total_rows"], row["matched_rows"], row["returned_rows"]) == (2, 1, 0)


def test_no_python_in_plans(spark):
    from jobsieve.registry import load

    queries, _ = load()
    def plan_of(name):
        return queries[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()

    for name in ("extract_postings", "city_listing", "tag_skills", "page_title_text"):
        assert "Python" not in plan_of(name)
    # Elements with depth have no native form: one walk over the page, in Arrow batches.
    for name in ("page_links", "listing_rows", "block_fields"):
        assert plan_of(name).count("ArrowEvalPython") == 1 and "BatchEval" not in plan_of(name)


def test_filters_and_columns_reach_the_scan(spark):
    from jobsieve.registry.base import table

    pages = table(spark, "/root/testdata/sf0.001", "pages")
    plan = pages.where("page_id < 5").select(F.col("url"))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(page_id), LessThan(page_id,5)]" in plan and "html" not in plan.split("ReadSchema")[1]
