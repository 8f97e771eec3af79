"""One key holding a third of all rows: results stay whole and exact, the
hot key is pre-reduced before the exchange, and positions of a hot group
spread over several tasks."""

from pyspark.sql import functions as F

from msgshield.operators.corpus import positional_split
from msgshield.operators.detect import dedup_first
from msgshield.operators.evidence import lookup

N = 3000


def _skewed(spark):
    # rows 0..999 share one text; the rest are distinct
    return spark.range(N).select(
        F.lit("s").alias("scope"), F.lit("src").alias("source"),
        F.when(F.col("id") < N // 3, F.lit("the hot message")).otherwise(
            F.concat(F.lit("message "), F.col("id").cast("string"))).alias("text"),
        (F.lit(N) - F.col("id")).alias("ord"),
        F.when(F.col("id") < N // 3, F.lit("hot")).otherwise(
            F.concat(F.lit("g"), (F.col("id") % 7).cast("string"))).alias("grp"))


def test_dedup_hot_key_exact_and_partial(spark):
    df = _skewed(spark).repartition(8)
    out = dedup_first(df)
    rows = out.collect()
    assert len(rows) == N - N // 3 + 1
    hot = [r for r in rows if r.text == "the hot message"][0]
    assert hot.ord == N - (N // 3 - 1)          # smallest ord of the hot rows
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan                 # map-side pre-reduction


def test_hot_group_positions_spread_and_exact(spark):
    df = _skewed(spark)
    # At 3,000 rows AQE would merge every range into one task; at scale the
    # ranges are sized by the advisory partition size. Show the split itself.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ordered = df.orderBy("grp", "ord").select(F.spark_partition_id().alias("p"), "grp")
        assert ordered.where(F.col("grp") == "hot").select("p").distinct().count() > 1
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    sp = positional_split(df, order="ord", by="grp")
    sizes = {r.grp: r["count"] for r in df.groupBy("grp").count().collect()}
    train = {r.grp: r["count"] for r in sp.where("split = 'train'").groupBy("grp").count().collect()}
    assert all(train[g] == int(0.9 * n) for g, n in sizes.items())
    assert sp.count() == N


def test_lookup_hot_id(spark):
    from msgshield.functions.text import evidence_id
    ev = (_skewed(spark).withColumn("id", evidence_id("text"))
          .withColumn("seq", F.col("ord")).withColumn("revision", F.lit(0))
          .withColumn("severity", F.lit("HIGH")))
    ids = spark.createDataFrame([("the hot message",), ("absent",)], "text string") \
        .select(evidence_id("text").alias("id"))
    got = {r.id: (r.found, r.seq) for r in lookup(ev, ids).collect()}
    assert sorted(v for v in got.values()) == [(False, None), (True, N - (N // 3 - 1))]
