"""Numbering by ranges and prefix sums."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from lacuna.operators import ranking, sampling
from lacuna.operators.ranking import numbered


def test_numbering_spreads_groups(spark):
    """One group of most rows, ties, null groups; numbers by group and over all rows."""
    df = spark.range(3000).select("id", F.when(F.col("id") % 10 < 8, "hot").when(F.col("id") % 10 == 8, F.col("id").cast("string")).alias("g"), (F.col("id") * 7 % 11).alias("x"))
    rows = numbered(df, ["x", "id"], by=["g"]).collect()
    groups = {}
    for r in sorted(rows, key=lambda r: r["number"]):
        groups.setdefault(r["g"], []).append((r["x"], r["id"], r["number"]))
    for members in groups.values():
        assert [m[2] for m in members] == list(range(1, len(members) + 1))
        assert members == sorted(members)
    everything = sorted((r["number"], r["x"], r["id"]) for r in numbered(df, ["x", "id"]).collect())
    assert [r[0] for r in everything] == list(range(1, 3001)) and [r[1:] for r in everything] == sorted(r[1:] for r in everything)


def test_firsts_keeps_all_that_count_and_few_others(spark):
    """The first rows of each group by a hash are those of a plain window; large groups are cut before anything is sorted, small ones stay whole."""
    rows = spark.range(60_000).select("id", F.when(F.col("id") < 3, "small").when(F.col("id") % 3 == 0, "some").otherwise("many").alias("g"))
    key = F.md5(F.concat(F.lit("42|"), F.col("id").cast("string")))
    ordered = Window.partitionBy("g").orderBy(key, "id")
    expected = {tuple(r) for r in rows.withColumn("n", F.row_number().over(ordered)).where("n <= 35").collect()}
    for digits in (1, 3):
        kept = ranking.firsts(rows, ["g"], key, 35, digits)
        assert {tuple(r) for r in kept.withColumn("n", F.row_number().over(ordered)).where("n <= 35").collect()} == expected
    sizes = {r.g: r["count"] for r in kept.groupBy("g").count().collect()}
    assert sizes["small"] == 3 and 35 <= sizes["some"] < 100 and 35 <= sizes["many"] < 100


def test_a_draw_cuts_its_candidates_first(spark):
    """Few of a column's cells reach the window that numbers them."""
    cells = spark.range(40_000).select(F.lit("t").alias("table_id"), F.lit("t.parquet").alias("file_basename"), F.col("id").alias("row_idx"), F.lit(0).alias("col_idx"), F.lit("c").alias("column"), (F.col("id") % 2 == 0).alias("missing"))
    found = sampling.candidates(cells, cells.select("table_id", "file_basename", "col_idx", "column").distinct(), None, 42, 5)
    assert found.count() == 10
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "__last" in plan
