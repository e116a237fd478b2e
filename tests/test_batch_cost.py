"""The pages of a batch are parsed once."""

from pyspark.sql import functions as F

from jobsieve.schema import POSTING_COLUMNS
from jobsieve.streaming import ingest as I


def test_a_batch_makes_each_posting_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def title(no):
        made.add(1)
        return f"Job {no}"

    rows = spark.range(60, numPartitions=3)
    ids = F.when(F.col("id") % 3 == 0, "").when(F.col("id") % 3 == 1, F.lit(None).cast("string")).otherwise(
        (F.col("id") % 4).cast("string"))
    known = {"title": F.udf(title, "string")("id"), "posting_id": ids, "url": F.col("id").cast("string"), "scraped_at": F.lit("1")}
    batch = rows.select(*[known.get(c, F.lit("")).alias(c) for c in POSTING_COLUMNS])
    paths = I.IngestPaths(str(tmp_path))
    I.batch_writer(paths)(batch, 0)
    kept = I.read_exports(spark, paths)
    assert made.value == 60
    assert kept.where("posting_id = ''").count() == 20 and kept.where("posting_id IS NULL").count() == 20
    assert sorted(r[0] for r in kept.where("posting_id <> ''").select("posting_id").collect()) == ["0", "1", "2", "3"]
