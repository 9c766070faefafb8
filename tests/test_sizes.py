"""What keeps large inputs whole and bounded: no table spread out, broadcast by mistake, or read as empty."""

from datetime import datetime
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from recollect.functions import extract, scores
from recollect.operators import graph, joins, lifecycle
from recollect.streaming import events, tiers


def test_sensory_filter_as_in_sql(spark):
    texts = ["Umé part ici", "No x and y", " no way", "  abc　", " abcde", "Nothing else", "um_x is kept", "\tno tab"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    import duckdb

    from recollect.plans import catalog

    connection = duckdb.connect()
    connection.sql("CREATE TABLE conversations (conv_id INT, turn INT, text VARCHAR)")
    connection.executemany("INSERT INTO conversations VALUES (?, 0, ?)", list(enumerate(texts)))
    want = [texts[r[0]] for r in connection.sql(catalog.SQL["sensory_filter"]).fetchall()]
    assert sorted(r.t for r in df.where(scores.passes_sensory_filter(F.col("t"))).collect()) == sorted(want) == sorted([" abcde", "Nothing else", "um_x is kept", "\tno tab"])


def test_stream_of_a_folder_of_parts(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k int, v int, t string")
    rows.repartition(3).write.parquet(f"{tmp_path}/d/turns.parquet")
    rows.toPandas().to_parquet(f"{tmp_path}/d/one.parquet")
    for name in ("turns.parquet", "one.parquet"):
        stream = events.event_stream(spark, f"{tmp_path}/d", name, at=None)
        got = events.latest(stream, ["k"], "v", f"{tmp_path}/{name}-work")
        assert sorted(r.t for r in got.collect()) == ["b", "c"]


def test_latest_of_an_empty_stream(spark, tmp_path):
    spark.createDataFrame([], "k int, v int").write.parquet(f"{tmp_path}/none")
    stream = spark.readStream.schema("k int, v int").parquet(f"{tmp_path}/none")
    assert events.latest(stream, ["k"], "v", f"{tmp_path}/work").collect() == []


def test_shortest_path_does_not_spread_out_a_hub(spark, monkeypatch):
    leaves = [f"x{i}" for i in range(300)]
    edges = spark.createDataFrame([(x, "r", "hub") for x in leaves] + [("hub", "r", "top")], "source string, relation string, target string")
    pairs = spark.createDataFrame([(x, "top") for x in leaves] + [("x0", "x7")], "start string, end string")
    sizes, plain = [], graph.cut

    def counted(rows):
        out = plain(rows)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(graph, "cut", counted)
    got = {(r.start, r.end): r.path for r in graph.shortest_path(edges, pairs).collect()}
    assert got == {(x, "top"): [x, "hub", "top"] for x in leaves} | {("x0", "x7"): ["x0", "hub", "x7"]}
    assert max(sizes) <= 3 * len(leaves)


@pytest.mark.parametrize("hops", [1, 2, 3, 4, 5])
def test_shortest_path_equals_breadth_first(spark, hops):
    import random

    draw = random.Random(hops)
    links = {(f"n{draw.randrange(14)}", f"n{draw.randrange(14)}") for _ in range(17)}
    step = {}
    for a, b in links:
        step.setdefault(a, set()).add(b)
        step.setdefault(b, set()).add(a)
    want = {}
    for start in step:
        layer, seen = {start: [start]}, {start: [start]}
        for _ in range(hops):
            grown = {}
            for node, path in layer.items():
                for there in step[node]:
                    if there not in seen:
                        grown[there] = min(grown.get(there, [*path, there]), [*path, there])
            layer = grown
            seen |= grown
        want |= {(start, end): path for end, path in seen.items()}
    edges = spark.createDataFrame([(a, "r", b) for a, b in links], "source string, relation string, target string")
    pairs = spark.createDataFrame([(a, b) for a in step for b in step], "start string, end string")
    assert {(r.start, r.end): r.path for r in graph.shortest_path(edges, pairs, hops).collect()} == want


def test_short_term_reads_its_state_once_a_batch():
    calls = []

    class State:
        value = []

        def __getattr__(self, name):
            def call(*args):
                calls.append(name)
                if name in ("appendValue", "appendList"):
                    self.value = self.value + (list(args[0]) if name == "appendList" else [args[0]])
                elif name in ("put", "update"):
                    self.value = args[0]
                elif name == "clear":
                    self.value = []
                return self.value if name == "get" else name == "exists" and bool(self.value)

            return call

    timers, states = set(), [State(), State()]
    handle = SimpleNamespace(getListState=lambda *a: states[0], getValueState=lambda *a: states[1], registerTimer=timers.add)
    memory = tiers.ShortTerm(5, 100, 200)
    memory.init(handle)
    rows = [SimpleNamespace(at=600 * i, event_id=i, topic=str(i % 3), importance=500, access=i % 4 == 0) for i in range(600)]
    now = SimpleNamespace(getCurrentWatermarkInMs=lambda: 90 * 3600 * 1000)
    list(memory.handleInputRows(("a",), iter(rows), now))
    out = []
    while due := sorted(t for t in timers if t <= now.getCurrentWatermarkInMs()):
        timers.remove(due[0])
        out += list(memory.handleExpiredTimer(("a",), now, SimpleNamespace(getExpiryTimeInMs=lambda t=due[0]: t)))
    assert [r.tick // 3600 for r in out if r.change == "tick"] == list(range(1, 91))
    assert len(calls) < 20 and min(timers) == 91 * 3600 * 1000


def test_lines_are_not_broadcast_to_entities(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(1, "Ann is tall. Bob goes to Rome")], "k int, text string").write.parquet(f"{tmp_path}/c")
    contexts, entities = spark.read.parquet(f"{tmp_path}/c"), spark.createDataFrame([("Ann",), ("Bob",)], "entity string")
    for most in (10, 1):
        monkeypatch.setattr(extract, "BROADCAST_NAMES", most)
        found = extract.facts_about_lines(contexts, entities, ["k"])
        plan = found._jdf.queryExecution().sparkPlan().toString()
        assert ("BuildRight" if most == 10 else "SortMergeJoin") in plan and "BuildLeft" not in plan
        assert sorted(r.value for r in found.collect()) == ["Rome", "tall"]


@pytest.mark.parametrize("rare", [1, 4, 1000])
def test_searches_of_classes_equal_all_pairs(spark, monkeypatch, rare):
    import random

    from recollect.functions import questions
    from recollect.operators import retrieval

    draw = random.Random(5)
    people, places = ["Ann", "An", "User", "Bob", "Rome", "Zed"], ["Rome", "Oslo", "tea", "green tea", "Ann", "Bobville", "in town"]
    facts = [(i, draw.choice(people), draw.choice(["lives in", "likes", "knows"]), draw.choice(places), i % 5 != 0) for i in range(160)]
    asked = [(i, draw.choice(["Where lives {} in {}", "Does Annabel like {} or {}", "What likes my {} and me in {}", "who knows {} {}"]).format(draw.choice(people), draw.choice(places))) for i in range(24)]
    f = spark.createDataFrame(facts, "fact_id long, subject string, predicate string, object string, is_current boolean")
    a = spark.createDataFrame(asked, "query_id long, q string")
    named = {r.query_id: r.e for r in a.select("query_id", questions.entities(F.col("q")).alias("e")).collect()}
    want = {"facts": set(), "keyword": set(), "entity": set(), "graph": set()}
    for q, text in asked:
        low, es = text.lower(), set(named[q])
        t = set(low.split())
        words = (t - set(retrieval.STOP_WORDS)) | ({"user"} if t & set(questions.SELF) else set())
        near = {y for _, s, _, o, _ in facts for x, y in ((s.lower(), o.lower()), (o.lower(), s.lower())) if x in es} - es
        scored = {n: [] for n in want}
        for i, s, p, o, current in facts:
            w, s, o = set(f"{s} {p} {o}".lower().split()), s.lower(), o.lower()
            if current and t & w:
                scored["facts"].append((-round(len(t & w) / (len(t) + 1) + 0.3 * (s in low) + 0.2 * (p in low), 6), i))
            if current and words & w:
                scored["keyword"].append((-round(len(words & w) / len(words) + 0.4 * (s in low) + 0.2 * any(x in o for x in words) + 0.5 * (s == "user" and bool(t & {"me", "my"})), 6), i))
            if current and es & {s, o}:
                scored["entity"].append((-round(0.3 + 0.2 * len(es & {s, o}), 6), i))
            if current and near & {s, o}:
                scored["graph"].append((-0.25, i))
        for n, rows in scored.items():
            want[n] |= {(q, i, rank) for rank, (_, i) in enumerate(sorted(rows)[:3], 1)}
    monkeypatch.setattr(retrieval, "RARE", rare)
    for n, search in {"facts": retrieval.search_facts, "keyword": retrieval.search_keyword, "entity": retrieval.search_entity, "graph": retrieval.search_graph}.items():
        assert {(r.query_id, r.fact_id, r["rank"]) for r in search(a, f, 3).collect()} == want[n], n


def test_sparse_products_hold_few_python_objects():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from recollect.operators import sparse

    keys = [[{"key": f"w{(i * 7 + j) % 500}", "weight": 1.0} for j in range(100)] for i in range(4000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(4000)), pa.array(keys), pa.array([0.0] * 4000)], names=["memory_id", "keys", "base"])
    run = sparse._best(SimpleNamespace(value=(1, {"w3": (np.zeros(1, np.int64), np.ones(1))})), 5, 9, 0.0, pa.int64())
    tracemalloc.start()
    found = pa.Table.from_batches(run(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found["memory_id"].to_pylist() == [i for i in range(4000) if any((i * 7 + j) % 500 == 3 for j in range(100))][:5]
    assert peak < 10_000_000


def test_mmr_gets_bounded_candidates(spark, monkeypatch):
    from recollect.operators import ranking
    from recollect.plans import catalog

    seen, plain = [], ranking.mmr_rerank
    monkeypatch.setattr(ranking, "mmr_rerank", lambda rows, **options: seen.append(rows.groupBy("query_id").count().agg(F.max("count")).first()[0]) or plain(rows, **options))
    catalog.QUERIES["mmr_rerank"](spark, "/root/testdata/sf0.001")
    assert seen == [20]


def test_best_line_of_equals(spark):
    from recollect.operators import answers

    texts = spark.createDataFrame([(-5, "x\nred fox"), (10, "fox red here\nno"), (-4, "red fox"), (3, None)], "memory_id long, text string")
    asked = spark.createDataFrame([(1, "red fox"), (2, "owl"), (3, "here")], "query_id long, text string")
    found = answers.best_line(asked, texts)
    assert "first(substring(line" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {r.query_id: r.line for r in found.collect()} == {1: "red fox", 2: "Not mentioned", 3: "fox red here"}


def test_candidates_of_a_jaccard_join_are_bounded_by_signatures(spark, monkeypatch):
    # 60 texts of 40 words that share 6 with all others, and one near copy
    words = lambda i: [f"w{i}_{j}" for j in range(34)] + [f"all{j}" for j in range(6)]
    rows = [(i, " ".join(words(i))) for i in range(60)] + [(60, " ".join([*words(7)[:-1], "other"])), (61, " ".join(words(8)))]
    kept = []
    cut = joins.cut
    monkeypatch.setattr(joins, "cut", lambda df: kept.append(cut(df)) or kept[-1])
    got = {(r.a, r.b, r.both) for r in joins.jaccard_pairs(spark.createDataFrame(rows, "id int, text string"), 60).collect()}
    assert got == {(7, 60, 39), (8, 61, 40)}
    assert [df.count() for df in kept if df.columns == ["a", "b"]] == [1]


def test_leaders_do_not_wait_for_a_chain_below_a_leader(spark, monkeypatch):
    pairs = [(0, b) for b in range(1, 25)] + [(a, a + 1) for a in range(1, 30)]
    calls, cut = [], lifecycle.cut
    monkeypatch.setattr(lifecycle, "cut", lambda df: calls.append(1) or cut(df))
    got = {r.id: r.leader for r in lifecycle.leaders(spark.range(32), spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(25)} | {25: 25, 26: 25, 27: 27, 28: 27, 29: 29, 30: 29, 31: 31}
    assert len(calls) <= 9


def test_a_date_is_parsed_in_its_own_format_only(spark):
    from recollect.operators import dated

    texts = ["7 May 2023", " may 7,  2023", "2023-05-07 or so", "May 2023", "2023", "20 people 2023", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(dated.leading_date(F.col("t")).alias("d"))
    assert [str(r.d) for r in df.collect()] == ["2023-05-07", "2023-05-07", "2023-05-07", "2023-05-15", "2023-06-15", "None", "None", "None"]
    # before, each of five forms was tried in five formats
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("gettimestamp") + plan.lower().count("try_to_date") <= 8


def test_scores_of_intents_stand_once_in_a_plan(spark):
    from recollect.functions import intents

    df = spark.createDataFrame([("How do I fix this?",)], "q string").select(intents.plan(F.col("q")).alias("p"))
    assert df.first().p.intent == "problem_solving"
    assert df._jdf.queryExecution().optimizedPlan().toString().count("pros and cons") <= 1


def test_rankings_of_all_candidates_join_no_texts(spark):
    from recollect.plans import catalog

    for name in ("dedupe_first", "rank_shift"):
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        windows = plan[: plan.index("Join Inner")]
        assert "text" not in windows and ("head" in windows or "chars" in windows)


def test_postings_of_questions_are_arrays(spark):
    import pyarrow as pa

    from recollect.operators import sparse

    keys = pa.chunked_array([pa.array([[{"key": "a", "weight": 1.0}, {"key": "b", "weight": 2.0}], None, [], [{"key": "b", "weight": 3.0}]])])
    known, starts, places, worth = sparse._postings(keys)
    assert [(places[s:e].tolist(), worth[s:e].tolist()) for k in "ab" for s, e in [starts[known[k] : known[k] + 2]]] == [([0], [1.0]), ([0, 3], [2.0, 3.0])]


def test_rows_of_one_small_file_are_dealt_to_tasks(spark):
    from recollect.plans import catalog

    for name in ("extract_facts", "duration_expression", "key_terms", "strip_timestamps"):
        assert catalog.QUERIES[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_facts_are_told_apart_as_before(spark):
    texts = ["Hi, I like b , tea and tea, and b.\nI like c", "é_i like x. -i like tea ; mi like no", "I've been friends with Bob for 3 weeks", None]
    found = extract.extract_facts(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, text string"))
    assert sorted((r.k, r.relation, r.object) for r in found.collect()) == [(0, "likes", "tea"), (1, "likes", "tea"), (2, "friends_with", "bob"), (2, "lasts", "3 weeks")]
    # before, every pattern put the text in lower case again
    assert found._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1


@pytest.mark.parametrize("many", [1_000_000, 3, 0])
def test_relations_meet_in_one_shuffle(spark, monkeypatch, many):
    import random

    from recollect.operators import rollups

    draw, names = random.Random(3), ["Supplier_1", "Supplier_2", None]
    rows = [(draw.choice(names), "r", draw.choice(names), draw.choice([0.1, 0.2, None]), draw.choice([None, {}, {"x": draw.choice("ab")}, {"y": None, "x": draw.choice("cd")}]), draw.randrange(4)) for _ in range(60)]
    relations = spark.createDataFrame(rows, "source string, relation string, target string, confidence double, properties map<string,string>, at int")
    want = {}
    for source, _, target, confidence, properties, at in rows:
        group = want.setdefault((source, target), [None, {}, 0])
        group[0] = max(group[0] or 0, confidence or 0) or None
        group[2] += 1
        for k, v in (properties or {}).items():
            group[1][k] = max(group[1].get(k, (-1, "")), (at, v or ""))
    monkeypatch.setattr(rollups, "MANY", many)
    merged = rollups.relation_rollup(relations, ["at"])
    got = {(r.source, r.target): [r.confidence, r.properties, r.n] for r in merged.collect()}
    assert got == {k: [c, {x: v or None for x, (_, v) in p.items()}, n] for k, (c, p, n) in want.items()}
    # before, heads and merged properties were shuffled and joined; relations of many mentions are still merged before they meet
    plan = rollups._merged(rollups.spread(relations.withColumn("_h", F.xxhash64("source", "relation", "target")), "_h"), ["at"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort [") == 1 and "Join" not in plan


@pytest.mark.parametrize("rare", [0, 2, 1000])
def test_short_memories_are_met_as_classes(spark, rare):
    import random

    from recollect.operators import mixed, sparse

    draw = random.Random(7)
    kind = "array<struct<key: string, weight: double>>"
    keys = lambda names, n: [(x, draw.choice([0.1, 0.2, 0.5])) for x in draw.sample(names, n)]
    asked = [(q, keys("abcdef", 3) + keys([f"n{i}" for i in range(40)], 2)) for q in range(25)] + [(90, []), (91, [("none", 1.0)])]
    memories = [(m, [(x, 1.0) for x in draw.sample("abc", draw.randrange(3))] + ([(f"n{draw.randrange(60)}", 0.5)] if m % 3 == 0 else [])) for m in range(300)]
    want = set()
    for q, ask in asked:
        scored = [(-round(sum(a * b for x, a in ask for y, b in held if x == y), 9), m) for m, held in memories]
        want |= {(q, m, -s, rank) for rank, (s, m) in enumerate(sorted(x for x in scored if x[0] < 0)[:6], 1)}
    found = sparse.classed_top(spark.createDataFrame(asked, f"query_id int, keys {kind}"), spark.createDataFrame(memories, f"memory_id int, keys {kind}"), 6, rare=rare)
    assert {(r.query_id, r.memory_id, r.score, r["rank"]) for r in found.collect()} == want
    # before, every fact was multiplied with all questions
    facts = spark.createDataFrame([(i, f"Z{i}", "likes", "tea", True) for i in range(50)], "fact_id int, subject string, predicate string, object string, is_current boolean")
    found = mixed.search_triplets(spark.createDataFrame([(1, "Who likes tea like Z7?")], "query_id int, q string"), facts, 3)
    assert [r.fact_id for r in found.orderBy("rank").collect()] == [7, 0, 1]
    assert "MapInArrow" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_questions_of_one_form_are_one_class(spark, monkeypatch):
    import random

    from recollect.operators import sparse

    draw = random.Random(11)
    kind = "array<struct<key: string, weight: double>>"
    forms = [[("a", 0.5), ("b", 0.25)], [("a", 0.5), ("c", 0.125)], [("d", 0.25)]]
    asked = [(q, forms[q % 3] + [(f"n{draw.randrange(60)}", 0.5)]) for q in range(150)] + [(900, []), (901, [("n3", 1.0)])]
    memories = [(m, [(x, 1.0) for x in draw.sample("abcd", draw.randrange(4))] + [(f"n{i}", 0.5) for i in draw.sample(range(80), draw.randrange(3))], draw.choice([None, 0.25])) for m in range(400)]
    want = set()
    for q, ask in asked:
        scored = [(sum(a * b for x, a in ask for y, b in held if x == y), m, base or 0.0) for m, held, base in memories]
        want |= {(q, m, -s, rank) for rank, (s, m) in enumerate(sorted((-round(s + base, 9), m) for s, m, base in scored if s > 0)[:5], 1)}
    counts, best = [], sparse._best
    monkeypatch.setattr(sparse, "_best", lambda shared, *options: counts.append(shared.value[0]) or best(shared, *options))
    found = sparse.sparse_top(spark.createDataFrame(asked, f"query_id int, keys {kind}"), spark.createDataFrame(memories, f"memory_id int, keys {kind}, base double").repartition(3), 5)
    assert {(r.query_id, r.memory_id, r.score, r["rank"]) for r in found.collect()} == want
    assert counts == [4]  # before, 152


def test_two_named_ends_meet_before_the_facts_of_a_hub(spark):
    import re

    from recollect.operators import retrieval

    rows = [(i, f"Z{chr(97 + i % 26)}{chr(97 + i // 26)}", "lives in", "Africa", True) for i in range(200)] + [(500, "Africa", "knows", "Zaa", True), (501, "Africa", "knows", "Africa", True)]
    facts = spark.createDataFrame(rows, "fact_id int, subject string, predicate string, object string, is_current boolean")
    asked = spark.createDataFrame([(1, "Does Zaa like Africa?"), (2, "Who lives in Africa?"), (3, "Where is Zba?")], "query_id int, q string")
    found = retrieval.search_entity(asked, facts, 3)
    got = {(r.query_id, r.fact_id, round(r.score, 6), r["rank"]) for r in found.collect()}
    assert got == {(1, 0, 0.7, 1), (1, 500, 0.7, 2), (1, 1, 0.5, 3), (2, 0, 0.5, 1), (2, 1, 0.5, 2), (2, 2, 0.5, 3), (3, 1, 0.5, 1)}
    # before, all ends of a hub met all questions that name it, and only then the other end was looked at
    joins = re.findall(r"Join Inner, \((.*)\)\n", found._jdf.queryExecution().optimizedPlan().toString())
    assert any("entity" in j and "other" in j for j in joins) and not any("query_id" in j and "other" in j for j in joins)
