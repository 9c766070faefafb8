"""Hybrid search on small tables, against plain sums."""

import random
from collections import defaultdict

import pytest

from recollect.operators import hybrid, sparse

KEYED = "array<struct<key: string, weight: double>>"
MEMORY = "memory_id long, content string, event_date string, speaker string, importance double, memory_type string"


@pytest.mark.parametrize("block", [2_000_000, 40])
def test_sparse_top_is_exact(spark, block):
    rnd = random.Random(1)
    keys = [f"k{i}" for i in range(30)]
    some = lambda n: [(k, float(rnd.randint(1, 4))) for k in rnd.sample(keys, n)]
    asked = [(f"q{i}", some(rnd.randint(0, 6))) for i in range(25)] + [("none", None)]
    memories = [(i, some(rnd.choice([0, 1, 5, 20]))) for i in range(400)] + [(1000, None), (1001, [("k1", -1.0)])]
    sums = defaultdict(dict)
    for q, a in asked:
        for m, b in memories:
            held = dict(b or [])
            total = sum(w * held.get(k, 0) for k, w in a or [])
            if total > 0:
                sums[q][m] = total
    want = sorted((q, m, s, rank) for q, found in sums.items() for rank, (m, s) in enumerate(sorted(found.items(), key=lambda x: (-x[1], x[0]))[:3], 1))
    a = spark.createDataFrame(asked, f"query_id string, keys {KEYED}")
    m = spark.createDataFrame(memories, f"memory_id long, keys {KEYED}").repartition(3)
    assert sorted(tuple(r) for r in sparse.sparse_top(a, m, 3, block).collect()) == want
    assert sparse.sparse_top(a.limit(0), m, 3).count() == 0 == sparse.sparse_top(a, m.limit(0), 3).count()


def test_pruning_keeps_the_best(spark):
    memories = [(i, [("a", float(i % 997)), ("b", 1.0)]) for i in range(60_000)]
    asked = [(q, [("a", 1.0)]) for q in range(2)] + [(9, [("b", 1.0)])]
    rows = sparse.sparse_top(spark.createDataFrame(asked, f"query_id long, keys {KEYED}"), spark.createDataFrame(memories, f"memory_id long, keys {KEYED}").coalesce(1), 2).collect()
    got = {(r.query_id, r.rank): (r.memory_id, r.score) for r in rows}
    assert got[0, 1] == (996, 996.0) and got[1, 2] == (1993, 996.0) and got[9, 1] == (0, 1.0) and got[9, 2] == (1, 1.0)


def test_boosts_and_reasons(spark):
    memories = spark.createDataFrame(
        [(1, "we went hiking", "7 May 2023", "Ann", 0.0, "fact"), (2, "we went hiking", None, "Bob", 0.0, "fact"), (3, "hiking in 2021", None, None, 1.0, "chat"), (4, "they love hiking", "June 2020", "", None, None), (5, None, None, None, None, None)], MEMORY
    )
    asked = spark.createDataFrame([(1, "When was hiking, 7 May 2023?"), (2, "Who went hiking, Ann?"), (3, "hiking"), (4, None)], "query_id long, q string")
    found = hybrid.basic_search(asked, memories)
    rows = {(r.query_id, r.memory_id): r.score for r in found.collect()}
    assert abs(rows[1, 1] - rows[1, 2] - 0.08) < 1e-6  # a date, and that date
    assert abs(rows[2, 1] - rows[2, 2] - 0.06) < 1e-6  # the speaker named
    assert rows[3, 1] == rows[3, 2] and (3, 5) not in rows and not [k for k in rows if k[0] == 4 and k[1] != 3]
    assert {r.memory_id for r in hybrid.basic_search(asked, memories, types=["chat"]).collect()} == {3}
    judged = {(r.query_id, r.memory_id): r.reason for r in hybrid.rerank(asked, found, memories).collect()}
    assert judged[1, 3] == "has_date" and judged[2, 1] == "speaker_match" and judged[2, 2] == "" and judged[3, 4] == ""


def test_memories_around_named_entities(spark):
    edges = spark.createDataFrame([("ann", "rome"), ("bob", "rome"), ("rome", "italy")], "source string, target string")
    index = spark.createDataFrame([("rome", i) for i in range(9, 0, -1)] + [("bob", 50), ("italy", 60), ("ann", 70)], "entity string, memory_id long")
    asked = spark.createDataFrame([(1, "what of Ann and Zoe"), (2, "nobody")], "query_id long, q string")
    rows = sorted((r.query_id, r.place, r.memory_id) for r in hybrid.graph_candidates(asked, edges, index).collect())
    # rome is one hop away, bob and italy two; Ann's own memories are not around her
    assert [r[2] for r in rows] == [1, 2, 3, 50, 60] and {r[0] for r in rows} == {1}
    memories = spark.createDataFrame([(i, f"memory {i}", None, None, 0.0, None) for i in (1, 2, 3, 50, 60, 70)], MEMORY)
    found = {r.memory_id: r.initial for r in hybrid.search(asked, memories, edges, index).collect() if r.query_id == 1}
    assert found == dict.fromkeys([1, 2, 3, 50, 60], 0.3)


def test_further_questions_only_where_few_came(spark):
    edges = spark.createDataFrame([("x", "y")], "source string, target string")
    index = spark.createDataFrame([], "entity string, memory_id long")
    memories = spark.createDataFrame([(i, "common words here", None, None, 0.0, None) for i in range(6)] + [(9, "what dates or times are mentioned", None, None, 0.0, None)], MEMORY)
    asked = spark.createDataFrame([(1, "common words"), (2, "when zzz")], "query_id long, q string")
    rows = hybrid.search_with_reasoning(asked, memories, edges, index).collect()
    told = {r.query_id: r.reasoning for r in rows}
    assert told[1] == "Initial search for: common words\nFound 6 relevant memories"
    assert told[2] == "Initial search for: when zzz\nFound 0 relevant memories\nFollow-up search: What dates or times are mentioned?"
    assert [r.memory_id for r in rows if r.query_id == 2] == [9] and len([r for r in rows if r.query_id == 1]) == 6
