"""One key holds most rows: results stay whole."""

from pyspark.sql import functions as F

from labelworks.operators import splits as P
from labelworks.operators.joins import resolved_gold
from labelworks.operators.metrics import classification_metrics, multilabel_metrics
from labelworks.operators.rank import first_rows
from labelworks.sources.sheets import collapse_coder_rows

N = 30_000


def test_hot_class_is_split_exactly(spark):
    df = spark.range(N).select("id", F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("c"), (F.col("id") % 50).cast("string"))).alias("label"))
    out = P.stratified_split(df, "label", "id", 3, 0.15, 0.42)
    n = {(r["label"], r["split"]): r["count"] for r in out.groupBy("label", "split").count().collect()}
    assert (n["hot", "train"], n["hot", "val"], n["hot", "test"]) == (3000, 8400, 8600)
    assert sum(n.values()) == N


def test_hot_quote(spark):
    df = spark.range(N).select(
        F.lit("s").alias("sheet"), F.col("id").alias("ord"),
        F.when(F.col("id") % 3 > 0, "same quote").otherwise(F.concat(F.lit("q"), (F.col("id") % 999).cast("string"))).alias("quote"),
        F.lit("T").alias("theme"), F.concat(F.lit("l"), (F.col("id") % 4).cast("string")).alias("level"),
    )
    items = collapse_coder_rows(df, ["sheet"], "ord", chunk=1000)
    hot = items.filter("content = 'same quote'").collect()
    assert len(hot) == 1 and hot[0]["gold"] == {"T": '["l1","l2","l0","l3"]'}
    assert items.count() == 1 + 333
    assert items.agg(F.max("idx"), F.countDistinct("idx")).first() == (333, 334)


def test_hot_text(spark):
    items = spark.range(N).select(
        F.col("id").alias("item_id"), F.when(F.col("id") % 3 > 0, "copy").otherwise(F.col("id").cast("string")).alias("content"),
        F.when(F.col("id") % 100 == 1, F.create_map(F.lit("D"), F.col("id").cast("string"))).otherwise(F.create_map().cast("map<string,string>")).alias("gold"),
    )
    got = resolved_gold(items, items)
    assert got.count() == N
    copies = items.filter("content = 'copy' AND item_id % 100 <> 1").select("item_id").join(got, "item_id")
    assert copies.select(F.col("gold_map")["D"].alias("g")).distinct().collect() == [("1",)]


def test_hot_group_counts(spark):
    pairs = spark.range(N).select(F.lit("d").alias("k"), F.when(F.col("id") % 3 > 0, "x").otherwise("y").alias("true"), F.lit("x").alias("pred"))
    m = classification_metrics(pairs, ["k"]).collect()[0]
    assert (m["n"], round(m["accuracy"], 6)) == (N, round(2 / 3, 6))
    sets = pairs.select("k", F.array("true").alias("gold"), F.array("pred").alias("pred"))
    assert multilabel_metrics(sets, ["k"]).collect()[0]["n"] == N


def test_groups_are_cut_before_the_shuffle(spark):
    keyed = spark.range(N).withColumn("k", F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id") % 7))
    top = first_rows(keyed, ["k"], ["id"], 3)
    assert [r["id"] for r in top.filter("k = 0").orderBy("id").collect()] == [0, 1, 2]
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2  # before and after the shuffle
