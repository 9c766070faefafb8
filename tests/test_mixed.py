"""Retrieval of several kinds on small tables."""

from pyspark.sql import functions as F

from recollect.operators import mixed

FACT = "fact_id long, subject string, predicate string, object string, is_current boolean"
ITEM = "memory_id long, text string, activation double, importance double, rehearsals long"


def test_wordings(spark):
    texts = ["What does he like?", "how long did they live here", "Where", "", None]
    got = [r.w for r in spark.createDataFrame([(t,) for t in texts], "t string").select(mixed.wordings(F.col("t")).alias("w")).collect()]
    assert got == [
        ["What does he like?", "what does he enjoy?", "what does he prefer?", "which does he like?"], ["how long did they live here", "how long did they reside here", "how long did they stay here", "duration did they live here"],
        ["Where", "what location"], [""], [""],
    ]


def test_kinds_share_one_ranking(spark):
    facts = spark.createDataFrame([(1, "Ann", "likes", "tea", True), (2, "Ann", "knows", "Bob", True), (3, "Bob", "lives in", "Oslo", True), (4, "Ann", "likes", "beer", False)], FACT)
    edges = facts.where("is_current").select(F.col("fact_id").alias("edge_id"), F.col("subject").alias("source"), F.col("predicate").alias("relation"), F.col("object").alias("target"))
    items = spark.createDataFrame([(1, "Ann came yesterday", 0.5, 0.5, 1), (2, "ann CAME yesterday", 0.4, 0.5, 1), (3, "nothing", 1.0, 1.0, 9), (4, None, 1.0, 1.0, 1)], ITEM)
    asked = spark.createDataFrame([(1, "When did Ann come"), (2, "Why does Ann like tea that Bob likes"), (3, None)], "query_id long, q string")
    seeds = spark.createDataFrame([(1, "Ann"), (2, "Ann")], "query_id long, node string")
    rows = mixed.retrieve(asked, facts, {"short": items}, edges, seeds).orderBy("query_id", "rank").collect()
    first = [r for r in rows if r.query_id == 1]
    assert first[0].source == "tiered_short" and first[0].source_id == "1"  # dated, and its copy in other letters is left out
    assert not [r for r in first if r.source_id in ("2", "3") and r.kind == "tier"] and not [r for r in first if r.kind == "path"]
    second = {(r.kind, r.source_id): r.content for r in rows if r.query_id == 2}
    assert second["path", "2>3"] == "Ann knows Bob -> Bob lives in Oslo" and ("graph", "4") not in second
    # the chain of one edge has the fact's own text: the better of both stays
    assert ("graph", "1") in second and ("path", "1") not in second or ("path", "1") in second and ("graph", "1") not in second
    assert not [r for r in rows if r.query_id == 3]
    assert mixed.retrieve(asked.limit(0), facts, {"short": items}, edges, seeds).count() == 0
