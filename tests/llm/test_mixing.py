from collections import Counter

from pyspark.sql import functions as F

from quarryline.llm.mixing import mix


def test_rates_reach_the_target_weights(spark):
    docs = spark.range(60_000).selectExpr("id as doc_id", "'t' as text", "case when id % 6 = 0 then 'a' when id % 6 < 3 then 'b' else 'c' end as source")
    got = mix(docs, {"a": 2.0, "b": 1.0, "c": 1.0}).groupBy("source").count().collect()
    n = {r.source: r["count"] for r in got}
    assert abs(n["a"] - 30_000) < 900 and abs(n["b"] - 15_000) < 600 and abs(n["c"] - 15_000) < 600


def test_counts_are_poisson_and_repeatable(spark):
    docs = spark.range(40_000).selectExpr("id as doc_id", "'s' as source", "7 as copy")
    out = mix(docs, epochs=1.5)
    assert out.columns == ["doc_id", "source", "copy", "mix_key"]
    per = Counter(r["count"] for r in out.groupBy("doc_id").count().collect())
    zero = 40_000 - sum(per.values())
    for k, share in ((0, 0.2231), (1, 0.3347), (2, 0.2510), (3, 0.1255)):
        assert abs((zero if k == 0 else per[k]) / 40_000 - share) < 0.012
    again = mix(docs.repartition(7), epochs=1.5)
    assert out.exceptAll(again).count() == 0 and again.exceptAll(out).count() == 0


def test_a_large_rate_is_split(spark):
    docs = spark.createDataFrame([(i, "rare" if i < 3 else "b") for i in range(3000)], "doc_id bigint, source string")
    got = {r.source: r["count"] for r in mix(docs, {"rare": 1.0, "b": 1.0}).groupBy("source").count().collect()}
    assert abs(got["rare"] - 1500) < 200 and abs(got["b"] - 1500) < 200


def test_edge_cases(edge, empty):
    assert mix(empty).collect() == []
    out = mix(edge, epochs=3.0)
    assert out.columns == [*edge.columns, "copy", "mix_key"]
    assert out.where("source is null").count() > 0
    assert out.groupBy("doc_id", "text").agg(F.max("copy").alias("m"), F.count("*").alias("n")).where("doc_id <> 2 and m + 1 <> n").count() == 0


def test_order_is_shuffled(spark):
    docs = spark.range(2000).selectExpr("id as doc_id", "'s' as source")
    ids = [r.doc_id for r in mix(docs).orderBy("mix_key").collect()]
    assert sum(a < b for a, b in zip(ids, ids[1:], strict=False)) < 0.6 * len(ids)
