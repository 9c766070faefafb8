"""Words inside words, recall by span, stored memories, relations, on small tables."""

import json

from pyspark.sql import functions as F

from recollect.functions import extract
from recollect.operators import grams, spans
from recollect.sources import memories as stored


def test_words_holding(spark):
    words = ["banana", "ban", "nab", "an", "a", "ñandú", "bananas", ""]
    parts = ["an", "ana", "banana", "a", "ñan", "xyz", "bananax", "", None]
    got = {tuple(r) for r in grams.words_holding(spark.createDataFrame([(p,) for p in parts], "part string"), spark.createDataFrame([(w,) for w in words] * 2, "word string")).collect()}
    assert got == {(p, w) for p in parts if p for w in words if p in w}


def test_a_substring_counts_one_and_a_word_half_more(spark):
    turns = spark.createDataFrame([(1, "Sunflower fields"), (2, "a flower, a FLOWER and flowers"), (3, "nothing"), (4, None)], "memory_id long, text string")
    asked = spark.createDataFrame([(1, "flower"), (2, "flow er"), (3, None)], "query_id long, text string")
    rows = {(r.query_id, r.memory_id): r.score for r in grams.search_inside(asked, turns).collect()}
    assert rows == {(1, 1): 1.0, (1, 2): 1.5, (2, 1): 1.0, (2, 2): 1.0}
    assert grams.search_inside(asked.limit(0), turns).count() == 0 == grams.search_inside(asked, turns.limit(0)).count()
    plan = grams.search_inside(asked, turns)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_span_recall(spark):
    items = spark.createDataFrame([(i, f"item number w{i} said x{i % 3}") for i in range(20)] + [(20, ""), (25, None)], "position long, text string")
    rows = {(r.span, r.place): (r.asked, r.recalled) for r in spans.span_recall(items, [10], k=1).collect()}
    assert rows == {(10, p): (2, 2) for p in (0, 2, 5, 7, 9)}  # texts without words are not asked for
    alike = items.withColumn("text", F.lit("the same text"))
    assert {(r.place): r.recalled for r in spans.span_recall(alike.where("position < 10"), [10], k=3).collect()} == {0: 1, 2: 1, 5: 0, 7: 0, 9: 0}


def test_stored_memories_round_trip(spark):
    types = ", ".join(f"{t} struct<{s.replace(' double', ': double').replace(' long', ': long').replace(' string', ': string').replace(' array', ': array').replace('::', ':')}>" for t, s in stored.TYPES.items())
    schema = f"id long, memory_type string, is_active boolean, importance struct<score: double, novelty: double, causal: double, emotional: double, frequency: double>, metadata struct<user_id: long, scope: string, source: string, tags: array<string>>, {types}"
    rows = [
        (1, "short_term", True, (0.1, None, None, None, 1e-9), (7, "s", None, ["a", 'b"c']), ([("user", "hi\n")], 20, "x", None), None, None, None),
        (2, "episodic", False, None, None, None, ([("error", "d", None)], "n", []), None, None),
        (3, "semantic", True, (1 / 3, 0.0, 0.0, 0.0, 0.0), (None, None, None, None), None, None, ([("s", "p", "o", 0.1 + 0.2)], "k", 0.7), None),
        (4, "long_term", None, None, None, None, None, None, ([1, 2], 2)),
        (5, "unknown", True, None, None, None, None, None, None),
    ]
    frame = spark.createDataFrame(rows, schema)
    packed = stored.pack_memories(frame)
    assert packed.where("id = 1").first().is_active == 1 and json.loads(packed.where("id = 1").first().metadata_json)["tags"] == ["a", 'b"c']
    back = {r.id: r for r in stored.read_memories(packed).collect()}
    for r in frame.collect():
        for c in ["memory_type", "is_active", *stored.TYPES]:
            assert back[r.id][c] == r[c], (r.id, c)
        assert back[r.id].corrupt == [] and (r.importance is None or back[r.id].importance == r.importance)
    broken = packed.withColumn("metadata_json", F.lit("{")).withColumn("type_data_json", F.when(F.col("id") == 1, "[1").otherwise(F.col("type_data_json")))
    got = {r.id: r for r in stored.read_memories(broken).collect()}
    assert got[1].corrupt == ["metadata_json", "type_data_json"] and got[2].corrupt == ["metadata_json"] and got[1].short_term is None and got[1].metadata is None and got[3].semantic.overall_confidence == 0.7


def test_relations_by_kind(spark):
    text = "I love tea. I like fish, I enjoy jam! I hate rain. I went to the market. I am Ann. We saw Bob, Ann and Bob in Rome."
    rows = spark.createDataFrame([(text, "Ann"), (None, "Ann"), (text, None), ("", "Ann")], "t string, s string").select(extract.extract_relations(F.col("t"), F.col("s")).alias("r")).collect()
    got = [(r["predicate"], r["object"]) for r in rows[0].r]
    assert [g for g in got if g[1] != "We"] == [("did", "went to the market"), ("mentioned", "Bob"), ("likes", "tea"), ("likes", "fish"), ("likes", "jam"), ("is/has", "Ann"), ("was_at", "Rome")]
    assert rows[1].r == rows[2].r == rows[3].r == []


def test_lines_about_entities(spark):
    contexts = spark.createDataFrame([(1, "Ann is tall, Ann has a dog.\nHannah is here. ann WORKED at the mill\nBob goes to Rome"), (2, None)], "k long, text string")
    entities = spark.createDataFrame([("Ann",), ("Bob",), ("a.b",)], "entity string")
    got = sorted((r.line, r.entity, r.predicate, r.value) for r in extract.facts_about_lines(contexts, entities, ["k"]).collect())
    assert got == [(0, "Ann", "has", "a dog"), (0, "Ann", "is", "tall"), (1, "Ann", "works", "the mill"), (2, "Bob", "went", "Rome")]
