"""Chains of evidence on a few facts."""

from recollect.operators import chains

FACT = "fact_id long, subject string, predicate string, object string, fact_type string, is_current boolean"
FACTS = [
    (1, "Ann", "lives in", "Rome", "location", True), (2, "Ann", "likes", "tea", "preference", True), (3, "Ann", "knows", "Bob", "relationship", True), (4, "Bob", "lives in", "Oslo", "location", True),
    (5, "Bob", "likes", "fish", "preference", False), (6, "Cid", "lives in", "Oslo", "location", True), (7, "Dee", "knows", "Cid", "relationship", True), (8, "Eve", "knows", "Cid", "relationship", True),
]


def test_evidence_uses_an_entity_once(spark):
    facts = spark.createDataFrame(FACTS, FACT)
    asked = spark.createDataFrame([(1, "if Ann met Bob, and Ann stayed"), (2, "nothing at all"), (3, None), (4, "Which friends has Zoe?")], "query_id long, q string")
    rows = chains.evidence_chain(asked, facts).orderBy("query_id", "step", "nth").collect()
    graph = [(r.step, r.entity, r.fact_id) for r in rows if r.query_id == 1 and r.source == "graph"]
    # Ann in her own step, Bob in his; the question itself names nobody new
    assert [g for g in graph if g[1] == "ann"] == [(0, "ann", 1), (0, "ann", 2), (0, "ann", 3)]
    assert all(g[0] == 1 for g in graph if g[1] == "bob")
    assert 5 not in {r.fact_id for r in rows}  # not current
    answers = {r.query_id: r for r in chains.chain_answers(asked, chains.evidence_chain(asked, facts)).collect()}
    assert answers[2].answer == answers[3].answer == answers[4].answer == "Insufficient information to answer." and answers[2].pieces == 0 and answers[3].confidence == 0
    assert answers[1].pieces == len([r for r in rows if r.query_id == 1])
    assert chains.evidence_chain(asked.limit(0), facts).count() == 0 == chains.evidence_chain(asked, facts.limit(0)).count()


def test_reasoning_chain_looks_around_where_a_part_adds_nothing(spark):
    facts = spark.createDataFrame(FACTS, FACT)
    states = spark.createDataFrame([], "fact_id long, subject string, description string")
    asked = spark.createDataFrame([(1, "Tell me where Ann lives today and tell me where Ann lives today"), (2, None)], "query_id long, q string")
    rows = chains.reasoning_chain(asked, facts, states, k=1).collect()
    first = {r.fact_id for r in rows if r.step == 0}
    second = {(r.fact_id, r.source) for r in rows if r.step == 1}
    assert first and {r.source for r in rows if r.step == 0} == {"search"}
    assert second and {s for _, s in second} == {"graph"} and not first & {f for f, _ in second}
    assert {r.query_id for r in rows} == {1}


def test_bridge_hop_only_without_evidence(spark):
    facts = spark.createDataFrame(FACTS, FACT)
    asked = spark.createDataFrame([(1, "Where is tea"), (2, "where is oslo"), (3, "the of"), (4, None)], "query_id long, q string")
    found = spark.createDataFrame([(1, 2)], "query_id long, fact_id long")
    rows = chains.bridge_hop(asked, found, facts).collect()
    assert [(r.query_id, r.terms, r.evidence) for r in rows] == [(2, "oslo", "Bob lives in Oslo | Cid lives in Oslo")]
    assert abs(rows[0].confidence - 0.7 * 0.5) < 1e-9


def test_context_lines(spark):
    asked = spark.createDataFrame([(1, "When did Café Müller open doors?"), (2, "x")], "query_id long, q string")
    contexts = spark.createDataFrame([(1, 7, "the café müller\n\n  \nopen doors when café\nopen"), (2, 8, "x y z"), (3, 9, "open doors")], "query_id long, key long, text string")
    rows = sorted((r.key, r.line, r.shared, round(r.confidence, 6)) for r in chains.context_lines_match(asked, contexts).collect())
    assert rows == [(7, 0, 2, 0.4), (7, 3, 4, 0.8)]
