"""Small tables with the cases that the operators must get right."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from recollect.functions import scores
from recollect.functions.tokens import jaccard, tokens, word_tokens
from recollect.operators import evaluation, graph, joins, tables


def column(spark, value, kind="double"):
    return spark.range(1).select(value.cast(kind).alias("x")).first().x


def test_decay_models(spark):
    for name, decay in scores.DECAY.items():
        at = [column(spark, decay(F.lit(1.0), 0.1, F.lit(1.0), F.lit(0), F.lit(float(h)))) for h in (0, 0.5, 12, 72, 500, 1000)]
        assert at[0] == 1 and all(0 <= x <= 1 for x in at) and at == sorted(at, reverse=True), name
    strong = column(spark, scores.decay_exponential(F.lit(1.0), 0.1, F.lit(1.5), F.lit(3), F.lit(10.0)))
    weak = column(spark, scores.decay_exponential(F.lit(1.0), 0.1, F.lit(0.5), F.lit(0), F.lit(10.0)))
    assert strong > weak
    steps = [column(spark, scores.decay_stepped(F.lit(1.0), 0.1, F.lit(1.0), F.lit(0), F.lit(float(h)))) for h in (0.5, 12, 72, 500, 1000)]
    assert steps == [1.0, 0.8, 0.6, 0.4, 0.2]


def test_tokens(spark):
    df = spark.createDataFrame([("  A b\tA\nc ", "b C d"), (None, ""), ("Été sur", "x")], "a string, b string")
    got = df.select(tokens(F.col("a")).alias("t"), jaccard(tokens(F.col("a")), tokens(F.col("b"))).alias("j"), word_tokens(F.col("a")).alias("w")).collect()
    assert [sorted(r.t) for r in got] == [["a", "b", "c"], [], ["sur", "été"]]
    assert [r.j for r in got] == [0.5, 0.0, 0.0] and got[2].w == ["été", "sur"]


def test_supersede_and_as_of(spark):
    facts = spark.createDataFrame([(1, "c", "NY", 1), (2, "c", "NY", 2), (3, "c", "SF", 3), (4, "d", "LA", 9)], "fact_id int, subject string, object string, at int")
    chain = {r.fact_id: (r.supersedes, r.superseded_by, r.is_current) for r in joins.supersede_chain(facts, ["subject"], "object", ["at"]).collect()}
    assert chain == {1: (None, 3, False), 3: (1, None, True), 4: (None, None, True)}
    assert [(r.subject, r.object) for r in joins.state_as_of(facts, ["subject"], "at", ["at"], F.lit(2)).collect()] == [("c", "NY")]


@pytest.mark.parametrize("percent", [50, 80, 100])
def test_jaccard_pairs_are_exact(spark, percent):
    rnd = random.Random(percent)
    rows = [(i, " ".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(0, 7)))) for i in range(80)] + [(90, None), (91, "")]
    got = {(r.a, r.b) for r in joins.jaccard_pairs(spark.createDataFrame(rows, "id int, text string"), percent).collect()}
    sets = [(i, set((t or "").split())) for i, t in rows]
    first = {i: min(j for j, y in sets if x == y) for i, x in sets}
    want = {(i, j) for i, x in sets for j, y in sets if i < j and x and y and first[i] == i and first[j] in (i, j) and 100 * len(x & y) >= percent * len(x | y)}
    assert got == want and len(got) < len([1 for i, x in sets for j, y in sets if i < j and x and y and 100 * len(x & y) >= percent * len(x | y)])


def test_copies_and_their_leaders(spark):
    from recollect.operators.lifecycle import duplicate_leaders

    rnd = random.Random(8)
    rows = [(i, " ".join(rnd.choice("abcdef") for _ in range(rnd.randint(0, 6)))) for i in range(60)] + [(70, None)]
    sets, lead = {i: set((t or "").split()) for i, t in rows}, {}
    for j, y in sets.items():
        near = [i for i, x in sets.items() if i < j and lead[i] == i and ((x == y) if not x or not y else 100 * len(x & y) >= 70 * len(x | y))]
        lead[j] = min(near) if near else j
    got = {r.id: r.leader for r in duplicate_leaders(spark.createDataFrame(rows, "id int, text string"), 70).collect()}
    assert {i: got[i] for i in sets if sets[i]} == {i: lead[i] for i in sets if sets[i]}


def test_graph_with_cycle_and_hub(spark):
    rows = [("a", "r", "b"), ("b", "r", "c"), ("c", "r", "a"), ("c", "r", "d"), ("d", "r", "e")] + [("hub", "r", f"x{i}") for i in range(12)]
    edges = spark.createDataFrame(rows, "source string, relation string, target string")
    seeds = spark.createDataFrame([("a",), ("hub",)], "seed string")
    got = {(r.seed, r.node): r.hop for r in graph.reach(edges, seeds, 3, undirected=False).collect()}
    assert {k[1]: v for k, v in got.items() if k[0] == "a"} == {"a": 0, "b": 1, "c": 2, "d": 3}
    assert sum(k[0] == "hub" for k in got) == 13
    assert {r.node: r.degree for r in graph.degree(edges).collect()}["c"] == 3
    near = {(r.seed, r.node): r.hop for r in graph.related(edges, seeds, 2).collect()}
    assert {k[1]: v for k, v in near.items() if k[0] == "a"} == {"b": 1, "c": 1, "d": 2} and sum(k[0] == "hub" for k in near) == 10
    pairs = spark.createDataFrame([("a", "e"), ("e", "b"), ("a", "hub"), ("a", "a")], "start string, end string")
    paths = {(r.start, r.end): (r.length, r.path) for r in graph.shortest_path(edges, pairs).collect()}
    assert paths == {("a", "e"): (3, ["a", "c", "d", "e"]), ("e", "b"): (3, ["e", "d", "c", "b"]), ("a", "a"): (0, ["a"])}
    assert {(r.seed, r.source, r.target) for r in graph.subgraph(edges, seeds.where("seed = 'a'")).collect()} == {("a", *e) for e in (("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"))}


def test_upsert_touch_and_filters(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 5)], "id int, v string, ver int")
    new = spark.createDataFrame([(1, "A", 2), (2, "late", 4), (3, "c", 1)], "id int, v string, ver int")
    assert sorted((r.id, r.v) for r in tables.upsert_by_key(old, new, ["id"], "ver").collect()) == [(1, "A"), (2, "b"), (3, "c")]
    assert [r.id for r in old.where(tables.where_spec({"v": {"$in": ["a"]}, "ver": {"$lt": 3}})).collect()] == [1]


def test_vector_knn(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [3.0, 3.0]), (4, [0.0, 0.0])], "vec_id long, embedding array<float>")
    asked = spark.createDataFrame([(7, [2.0, 0.0])], "query_id long, embedding array<float>")
    got = [(r.vec_id, round(r.similarity, 3), r["rank"]) for r in joins.vector_knn(asked, vectors, 2, 0.1).orderBy("rank").collect()]
    assert got == [(1, 1.0, 1), (3, 0.707, 2)]
    with pytest.raises(ValueError):
        joins.vector_knn(asked.union(asked), vectors, 2, 0.1, max_queries=1)


def test_vector_knn_in_blocks(spark):
    rnd = random.Random(2)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(6)]) for i in range(60)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = vectors.where("vec_id < 40").withColumnRenamed("vec_id", "query_id")

    def found(**more):
        return sorted((r.query_id, r.vec_id, r["rank"], round(r.similarity, 9)) for r in joins.vector_knn(asked, vectors, 3, 0.1, **more).collect())

    assert found(block=7) == found() and {r[0] for r in found(block=7)} == set(range(40))
    big = spark.range(10_001).selectExpr("id as query_id", "array(float(id), 1f) as embedding")
    assert joins.vector_knn(big, vectors.selectExpr("vec_id", "slice(embedding, 1, 2) as embedding"), 1, -1.0).count() == 10_001


def test_answer_metrics(spark):
    df = spark.createDataFrame([("The  Cat!", "a cat"), ("", "x"), ("x x y", "y z")], "p string, t string")
    got = df.select(evaluation.exact_match(F.col("p"), F.col("t")).alias("e"), evaluation.token_f1(F.col("p"), F.col("t")).alias("f")).collect()
    assert [(r.e, r.f) for r in got] == [(True, 1.0), (False, 0.0), (False, 0.5)]


def test_sensory_filter(spark):
    df = spark.createDataFrame([("Hiking is fun",), ("hi there you",), ("12345",), ("abc",), (None,)], "t string")
    assert [r.t for r in df.where(scores.passes_sensory_filter(F.col("t"))).collect()] == ["Hiking is fun"]


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_leaders_equal_the_greedy_pass(spark):
    from recollect.operators.lifecycle import leaders

    rnd = random.Random(3)
    for n, share in ((30, 0.1), (20, 0.4), (5, 0.0)):
        pairs = [(i, j) for j in range(n) for i in range(j) if rnd.random() < share]
        lead = {}
        for j in range(n):
            found = [i for i, k in pairs if k == j and lead[i] == i]
            lead[j] = min(found) if found else j
        rows, edges = spark.createDataFrame([(i,) for i in range(n)], "id int"), spark.createDataFrame(pairs, "a int, b int")
        assert {r.id: r.leader for r in leaders(rows, edges).collect()} == lead


def test_extraction(spark):
    from recollect.functions import extract

    turns = spark.createDataFrame([("Caroline", "[1:56 pm on 8 May, 2023] I really love hiking! I moved from Sweden 4 years ago."), ("Bob", "Bob: I work at Acme , and my dog is mine.")], "who string, text string")
    clean = turns.withColumn("text", extract.clean_format(extract.strip_timestamps(F.col("text"))))
    facts = {(r.who, r.relation, r.object) for r in extract.extract_facts(clean).collect()}
    assert facts == {("Caroline", "likes", "hiking"), ("Caroline", "moved_from", "sweden"), ("Bob", "works_at", "acme")}
    got = clean.select("who", extract.resolve_first_person(F.col("text"), F.col("who")).alias("t"), extract.duration_days(F.col("text")).alias("d")).orderBy("who").collect()
    assert got[0].t == "Bob work at Acme, and Bob's dog is Bob's." and [r.d for r in got] == [None, 1460]
    dates = spark.createDataFrame([("7 May 2023",), ("May 7, 2023",), ("2023-05-07",), ("May 2023",), ("2023",), ("soon",)], "t string")
    assert [str(r.x) for r in dates.select(extract.parse_date_any(F.col("t")).alias("x")).collect()] == ["2023-05-07"] * 3 + ["2023-05-15", "2023-06-15", "None"]


def test_intents(spark):
    from recollect.functions.intents import classify_intent

    asked = {"What is the meaning of life": "factual", "Do you remember what happened": "episodic_recall", "How to bake, steps to follow": "procedural", "fix this bug, it fails": "problem_solving", "compare a vs b": "comparison", "xyz": "general", None: "general"}
    df = spark.createDataFrame([(q,) for q in asked], "q string").select(classify_intent(F.col("q")).alias("i"))
    assert [r.i.intent for r in df.collect()] == list(asked.values())


def test_readers(spark, tmp_path):
    import json

    from recollect.sources.conversations import hash_embedding, pack_json, read_haystack_json, read_sessions_json, tag_index

    talk = {f"session_{n}": [{"speaker": "A", "text": f"turn {n}"}, {"speaker": "B", "text": "answer"}] for n in (1, 2, 10)}
    talk |= {f"session_{n}_date_time": f"{n} May 2023" for n in (1, 2, 10)} | {"speaker_a": "A"}
    (tmp_path / "a.json").write_text(json.dumps([{"sample_id": "s", "conversation": talk, "qa": []}]))
    got = read_sessions_json(spark, str(tmp_path / "a.json")).orderBy("session", "seq").collect()
    assert [(r.session, r.seq, r.speaker) for r in got] == [(n, i, w) for n in (1, 2, 10) for i, w in enumerate("AB")]
    assert got[-1].said_on == "10 May 2023"
    ask = [{"question_id": f"q{i}", "question_type": t, "haystack_sessions": [[{"role": "user", "content": "hi"}], [{"role": "user", "content": "x"}, {"role": "assistant", "content": "y"}]], "haystack_dates": ["d1", "d2"], "haystack_session_ids": ["a", "b"]} for i, t in enumerate("uvu")]
    (tmp_path / "b.json").write_text(json.dumps(ask))
    rows = read_haystack_json(spark, str(tmp_path / "b.json"), question_type="u", limit=1).orderBy("session", "seq").collect()
    assert [(r.question_id, r.session_id, r.seq, r.text, r.said_on) for r in rows] == [("q0", "a", 0, "hi", "d1"), ("q0", "b", 0, "x", "d2"), ("q0", "b", 1, "y", "d2")]
    tagged = spark.createDataFrame([(1, ["a", "b", "a"]), (2, [])], "id int, tags array<string>")
    assert sorted(map(tuple, tag_index(tagged).collect())) == [(1, "a"), (1, "b")]
    assert pack_json(tagged, ["tags"]).orderBy("id").first().data == '{"tags":["a","b","a"]}'
    vectors = spark.createDataFrame([("the cat sat the",), ("",)], "t string").select(hash_embedding(F.col("t")).alias("v")).collect()
    assert abs(sum(x.weight**2 for x in vectors[0].v) - 1) < 1e-9 and len(vectors[0].v) == 3 and vectors[1].v == []


def test_ranking(spark):
    from recollect.operators import ranking

    rows = [(1, 1, 0.9, "a b c", "x"), (1, 2, 0.89, "a b c", "x"), (1, 3, 0.7, "d e f", "y"), (2, 4, 0.5, "z", "x")]
    df = spark.createDataFrame(rows, "query_id long, memory_id long, score double, text string, tier string")
    got = {(r.query_id, r["rank"]): r.memory_id for r in ranking.mmr_rerank(df).collect()}
    assert got == {(1, 1): 1, (1, 2): 3, (1, 3): 2, (2, 1): 4}
    assert [r.memory_id for r in ranking.per_tier_cap(df, "tier", 1, 2).where("query_id = 1").orderBy("rank").collect()] == [1, 3]
    assert sorted(r.memory_id for r in ranking.dedupe_first(df, "text", ["memory_id"]).collect()) == [1, 3, 4]
    assert {r.memory_id: round(r.score, 2) for r in ranking.diversity_bonus(df, "tier").collect()} == {1: 1.0, 2: 0.89, 3: 0.8, 4: 0.6}


def test_conflicts(spark):
    from recollect.operators import conflicts

    triplets = spark.createDataFrame([(1, "c", "lives_in", "NY", True), (2, "c", "lives_in", "SF", True), (3, "c", "likes", "x", True), (4, "c", "dislikes", "x", True), (5, "c", "likes", "y", True), (6, "d", "lives_in", "SF", True), (7, "c", "lives_in", "LA", False), (8, "c", "lives_in", "sf", True)], "triplet_id long, source string, relation string, target string, is_current boolean")
    assert sorted(map(tuple, conflicts.triplet_conflicts(triplets).collect())) == [("c", 1, 2, "exclusive"), ("c", 3, 4, "polarity")]
    shape = "fact_id long, created_at timestamp_ntz, confidence double, access_count int, importance double, source string"
    from datetime import datetime

    facts = spark.createDataFrame([(1, datetime(2024, 1, 1), 0.9, 1, 0.1, "inference"), (2, datetime(2024, 1, 21), 0.5, 9, 0.8, "system"), (3, datetime(2024, 1, 21), 0.5, 9, 0.8, "system")], shape)

    def won(a, b, strategy):
        r = conflicts.resolve(spark.createDataFrame([(a, b)], "a long, b long"), facts, strategy).first()
        return r.action, r.winner, round(r.confidence, 6)

    assert [won(1, 2, s) for s in conflicts.STRATEGIES] == [("keep_b", 2, 0.7), ("keep_a", 1, 0.9), ("keep_b", 2, 0.9), ("keep_b", 2, 0.9), ("keep_b", 2, 0.95), ("merge", None, 0.7), ("keep_both", None, 0.5), ("defer", None, 0.0)]
    # of equals the first wins, the second by recency
    assert [won(2, 3, s) for s in list(conflicts.STRATEGIES)[:5]] == [("keep_b", 3, 0.5), ("keep_a", 2, 0.5), ("keep_a", 2, 0.75), ("keep_a", 2, 0.6), ("keep_a", 2, 0.6)]
    pairs = spark.createDataFrame([(1, 2)], "a long, b long")
    assert [(r.fact_id, r.status) for r in conflicts.apply_resolutions(facts, conflicts.resolve(pairs, facts, "recency")).orderBy("fact_id").collect()] == [(2, "kept"), (3, "kept")]
    assert [(r.fact_id, r.status) for r in conflicts.apply_resolutions(facts, conflicts.resolve(pairs, facts, "keep_both")).orderBy("fact_id").collect()] == [(1, "conflicted"), (2, "conflicted"), (3, "kept")]
    assert spark.range(1).select(conflicts.choose_strategy(F.lit("preference_conflict"), F.lit("critical")).alias("x")).first().x == "user_guided"


def test_updates_of_facts_in_order(spark):
    from recollect.operators import conflicts

    rows = [(1, "Caroline", "likes", "hiking", 1), (2, "caroline", "like", "Hiking", 2), (3, "Caroline", "dislikes", "hiking", 3), (4, "Caroline", "lives in", "New York", 4), (5, "Caroline", "lives in", "San Francisco", 5), (6, "Caroline", "likes", "swimming", 6)]
    got = {r.fact_id: (r.outcome, r.superseded_by) for r in conflicts.fold_updates(spark.createDataFrame(rows, "fact_id long, subject string, predicate string, object string, at int"), ["at"]).collect()}
    assert got == {1: ("new", 3), 2: ("duplicate", None), 3: ("supersedes", None), 4: ("new", 5), 5: ("supersedes", None), 6: ("new", None)}


def test_small_operators(spark):
    from recollect.operators import facts

    rows = spark.createDataFrame([(1, ("x", ["p", "q"], [("no",)], ("deep",)))], "id int, m struct<a: string, tags: array<string>, skipped: array<struct<z: string>>, more: struct<b: string>>")
    assert facts.flatten_metadata(rows, "m").first().asDict() == {"id": 1, "a": "x", "tags": "p,q", "more.b": "deep"}
    old, new = spark.createDataFrame([(1, 5, "a"), (2, 6, "b")], "vec_id int, x int, t string"), spark.createDataFrame([(2, None, "c"), (3, 7, "d")], "vec_id int, x int, t string")
    assert sorted(map(tuple, facts.vector_update(old, new).collect())) == [(1, 5, "a"), (2, 6, "c"), (3, 7, "d")]
    near = spark.createDataFrame([(1, 9, 0.97, 0, False), (2, 9, 0.5, 5, False), (3, 9, 0.5, 1, True), (4, 9, 0.05, 9, False), (5, 9, 0.3, 1, False)], "id int, other int, similarity double, fresh int, contradicts boolean")
    assert {r.id: (r.action, r.target) for r in facts.decide(near, spark.range(1, 7)).collect()} == {1: ("NOOP", 9), 2: ("UPDATE", 9), 3: ("DELETE", 9), 4: ("ADD", None), 5: ("ADD", None), 6: ("ADD", None)}


def test_folder_is_only_local_on_one_machine(spark, monkeypatch):
    from recollect.operators import shared

    class Elsewhere:
        class sparkContext:
            master = "spark://head:7077"

            class _jsc:
                @staticmethod
                def sc():
                    return type("c", (), {"getCheckpointDir": staticmethod(lambda: type("o", (), {"isDefined": staticmethod(lambda: False)}))})

            @staticmethod
            def getConf():
                return {}

        class conf:
            @staticmethod
            def get(*_):
                return None

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_folder(Elsewhere)
    assert shared.shared_folder(spark)


def test_what_copies_are_alike_with_counts_too(spark):
    from recollect.operators import lifecycle

    # 1 and 2 have one set of words, 3 is near it; the copy 2 is longer than 3, so 3 goes although the first of the set is shorter
    words = [f"w{i}" for i in range(20)]
    rows = [(1, " ".join(words)), (2, " ".join(words + words)), (3, " ".join([*words, "more"])), (4, "else"), (5, ""), (6, " ".join([*words, "else"]))]
    docs = spark.createDataFrame(rows, "id int, text string").withColumn("size", F.length("text"))
    kept = lifecycle.keep_better(docs, joins.jaccard_pairs(docs, 80), [F.col("size")])
    assert {r.id for r in kept.collect()} == {2, 4, 5}
