import json

from pyspark.sql import functions as F

from jobsieve.operators.extract import drop_challenge
from jobsieve.operators.stats import kind_summary
from jobsieve.plans.export_report import jobs, statistics
from jobsieve.schema import POSTING, POSTING_COLUMNS
from jobsieve.sources import exports as E
from jobsieve.sources import json_results as J
from jobsieve.sources import store as S


def postings(spark, *rows):
    base = {c: "" for c in POSTING_COLUMNS} | {"is_sponsored": "No"}
    return spark.createDataFrame([tuple((base | r)[c] for c in POSTING_COLUMNS) for r in rows], POSTING)


TRICKY = ['say "hi", then leave', "line one\nline two\r\nthree", " padded ", 'ends with quote"', "back\\slash, \\\" mix", "ünï 🎁", ""]


def test_csv_round_trip(spark, tmp_path):
    df = postings(spark, *[{"title": t, "description": t, "posting_id": str(i)} for i, t in enumerate(TRICKY)])
    E.write_postings_csv(df, str(tmp_path / "x"))
    back = E.read_postings_csv(spark, str(tmp_path / "x"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_limits_and_defaults_on_write(spark, tmp_path):
    row = {"requirements": "r" * 600, "benefits": "b" * 600, "description": '"' * 1200, "is_sponsored": ""}
    E.write_postings_csv(postings(spark, row), str(tmp_path / "x"))
    got = E.read_postings_csv(spark, str(tmp_path / "x")).first()
    assert (len(got["requirements"]), len(got["benefits"]), got["description"], got["is_sponsored"]) == (500, 300, '"' * 1000, "No")


def test_export_names():
    assert E.export_name("2025-07-01", quick=True, auto=True) == "regular_jobs_quick_auto_2025-07-01.csv"
    assert E.export_name("2025-07-01") == "regular_jobs_2025-07-01.csv"
    assert E.batch_name(3, "2025-07-01") == "jobs_batch_3_2025-07-01.csv"


def test_catalog_and_day_selection(spark, tmp_path):
    root = str(tmp_path / "exports")
    df = postings(spark, {"title": "Engineer", "location": "Riyadh", "salary": "100"}, {"title": "Cook", "location": "Abha", "salary": ""},
                  {"title": "Sales engineer", "location": "Riyadh", "salary": "90"})
    dated = df.withColumn("export_date", F.when(F.col("title") == "Cook", "2025-07-01").otherwise("2025-07-02"))
    E.write_postings_csv(dated.coalesce(1), root, partition_by=("export_date",))
    catalog = E.list_exports(spark, root).collect()
    assert [(r["date"], r["job_count"]) for r in catalog] == [("2025-07-02", 2), ("2025-07-01", 1)]
    exports = E.read_postings_csv(spark, root)
    assert E.latest_export(exports).count() == 2
    assert E.export_for(exports, "2025-07-01").first()["title"] == "Cook" and E.export_for(exports, "2020-01-01").count() == 0
    rows, info = jobs(exports, search="engineer", location="riyadh", salary_min=95, limit=5)
    assert [r["title"] for r in rows.collect()] == ["Engineer"] and info.first()["total_rows"] == 2
    stats = statistics(exports, "2025-07-02").first()
    assert stats["salary_analysis"]["median"] == 100 and stats["locations"]["top_locations"][0]["n"] == 2


def test_catalog_reads_dates_from_names(spark, tmp_path):
    (tmp_path / "regular_jobs_quick_auto_2025-07-03.csv").write_text('"Job Title"\n"x"\n')
    (tmp_path / "other.csv").write_text('"Job Title"\n')
    got = E.list_exports(spark, str(tmp_path), with_counts=True).collect()
    assert {(r["filename"], r["date"], r["job_count"]) for r in got} == {
        ("regular_jobs_quick_auto_2025-07-03.csv", "2025-07-03", 1), ("other.csv", "unknown", 0)}


def test_export_folders(spark, tmp_path):
    root = str(tmp_path / "x")
    tagged = E.with_export_folders(postings(spark, {"title": "a"}), "2025-07-01", quick=True, auto=True)
    E.write_postings_csv(tagged, root, partition_by=("mode", "export_date"))
    row = E.read_postings_csv(spark, root).first()
    assert (row["title"], row["mode"], str(row["export_date"])) == ("a", "quick_auto", "2025-07-01")


def test_append_counts_new_rows(spark, tmp_path):
    root = str(tmp_path / "e")
    a = postings(spark, {"posting_id": "1"}, {"posting_id": "2"}, {"posting_id": ""})
    assert E.append_export(a, root, "2025-07-01") == 3
    assert E.append_export(a, root, "2025-07-01", spark.read.parquet(root)) == 1
    assert E.append_export(a, str(tmp_path / "b"), "2025-07-01", batch_id=4) == 3
    assert E.append_export(a, str(tmp_path / "b"), "2025-07-01", batch_id=4) == 3
    assert spark.read.parquet(str(tmp_path / "b")).count() == 3


def test_seen_versions(spark, tmp_path):
    root = str(tmp_path / "seen")
    assert S.read_seen(spark, root).count() == 0
    row = "'1' posting_id, 't' title, 'u' url, current_timestamp() scraped_date, current_timestamp() first_scraped, current_timestamp() last_updated"
    assert S.write_seen(spark.sql(f"SELECT {row}"), root) == 1
    (tmp_path / "seen" / "v=9").mkdir()
    assert S.store_size_kb(spark, root).first()[0] >= 1
    assert S.read_seen(spark, root).count() == 1
    assert S.write_seen(S.read_seen(spark, root).limit(0), root) == 2 and S.read_seen(spark, root).count() == 0
    assert S.read_seen_log(spark, str(tmp_path / "none")).count() == 0


def test_response_json(spark, tmp_path):
    blocked = {"title": "www.listings.example.com", "description": "Verify you are human by completing the action below.",
               "type": "job_detail", "additional_details": {}, "error": None}
    data = [blocked] * 5 + [{"title": "Job Category: abha", "description": "list", "type": "category"}] * 3
    doc = {"success": True, "count": 8, "data": data, "summary": {"job_details": 5, "categories": 3, "with_salary": 0, "with_company": 0, "errors": 0}}
    (tmp_path / "r.json").write_text(json.dumps(doc, indent=2))
    rows, summary = J.read_response_json(spark, str(tmp_path / "r.json"))
    assert kind_summary(rows).first().asDict() == doc["summary"]
    assert drop_challenge(rows, "description").count() == 3
    assert summary.first()["count"] == 8
    out = str(tmp_path / "out")
    J.write_json(rows.select("title", "salary"), out)
    assert '"salary":null' in spark.read.text(out).first()[0]
    assert J.to_json_rows(rows.select("title", "salary").limit(1)).first()["json"].endswith('"salary":null}')
