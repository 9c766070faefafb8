"""Rollups, decisions and their application on small tables."""

from recollect.operators import facts, mixed, rollups


def test_entities_and_relations(spark):
    mentions = spark.createDataFrame([("New_York", "city", 2), (" new york ", "place", 1), (None, "x", 0), ("Rome", None, 3)], "name string, kind string, at int")
    assert sorted((r.name, r.spelling, r.kind, r.mentions) for r in rollups.entity_rollup(mentions, ["at"]).collect()) == [("new york", " new york ", "place", 2), ("rome", "Rome", None, 1)]
    relations = spark.createDataFrame([("a", "r", "b", 0.5, {"x": "1", "y": "2"}, 1), ("a", "r", "b", 0.9, {"x": "3"}, 2), ("a", "q", "b", 0.1, None, 3), ("a", None, "b", 0.2, {"z": "1"}, 4)], "source string, relation string, target string, confidence double, properties map<string,string>, at int")
    got = {r.relation: (r.confidence, r.properties, r.n) for r in rollups.relation_rollup(relations, ["at"]).collect()}
    assert got == {"r": (0.9, {"x": "3", "y": "2"}, 2), "q": (0.1, {}, 1), None: (0.2, {"z": "1"}, 1)}
    first = {r.relation: (r.at, r.n) for r in rollups.triplet_rollup(relations, ["at"], ["at"]).collect()}
    assert first == {"r": (1, 2), "q": (3, 1), None: (4, 1)}


def test_facts_merge(spark):
    rows = [(1, "A", "likes", "Tea", 0.5, 2, ["x", "y"]), (2, "a", "LIKES", "tea", 0.9, 3, ["y"]), (3, "b", None, "c", 0.95, 1, None), (4, "b", None, "c", 0.1, 1, [])]
    frame = spark.createDataFrame(rows, "fact_id long, subject string, predicate string, object string, confidence double, evidence long, sources array<string>")
    got = sorted((r.fact_id, r.subject, round(r.confidence, 6), r.evidence, r.sources) for r in rollups.merge_facts(frame, ["fact_id"]).collect())
    assert got == [(1, "a", 0.6, 5, ["x", "y"]), (3, "b", 1.0, 2, [])]


def test_decisions_by_precedence_and_applied(spark):
    near = spark.createDataFrame(
        [(1, 9, 0.5, 5, True), (1, 8, 0.97, 0, False), (2, 9, 0.6, 1, False), (2, 8, 0.5, 9, False), (3, 9, 0.6, 4, False), (3, 8, 0.2, 9, True), (4, 9, 0.6, 4, False), (5, 7, 0.9, 3, False)], "id int, other int, similarity double, fresh int, contradicts boolean"
    )
    decided = facts.decide(near, spark.range(1, 7))
    assert {r.id: (r.action, r.target) for r in decided.collect()} == {1: ("NOOP", 8), 2: ("ADD", None), 3: ("DELETE", 8), 4: ("UPDATE", 9), 5: ("UPDATE", 7), 6: ("ADD", None)}
    memories = spark.createDataFrame([(7, "Old one"), (8, "Gone"), (9, "Kept. Here")], "memory_id int, text string")
    candidates = spark.createDataFrame([(i, 100 + i, f"Text {i}") for i in range(1, 7)], "id long, memory_id int, text string")
    after = sorted((r.memory_id, r.text) for r in facts.apply_decisions(memories, candidates, decided).collect())
    assert after == [(7, "Old one. Text 5."), (9, "Here. Kept. Text 4."), (102, "Text 2"), (103, "Text 3"), (106, "Text 6")]


def test_context_leaves_out_what_does_not_fit(spark):
    rows = [(1, "graph", 1, "a fact"), (1, "tier", 2, "x" * 60), (1, "tier", 3, "short"), (1, "path", 4, "a -> b -> c -> d"), (2, "tier", 1, "only")] + [(3, "path", i, f"p{i}") for i in range(1, 6)]
    found = spark.createDataFrame(rows, "query_id long, kind string, rank int, content string")
    got = {r.query_id: r.context for r in mixed.build_context(found, limit=50).collect()}
    assert got == {1: "FACTS:\n- a fact\n\nREASONING PATHS:\n- a -> b -> c\n\nMEMORIES:\n- short", 2: "\nMEMORIES:\n- only", 3: "\nREASONING PATHS:\n- p1\n- p2\n- p3"}
