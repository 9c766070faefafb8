import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from recollect.llm import ranked_search as module
from recollect.llm.ranked_search import Segment, ranked_search, terms

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_terms(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def brute(docs, items, k=10):
    words = [(d, plain_terms(t)) for d, t in docs]
    filled = [w for _, w in words if w]
    n_docs, total = len(filled), sum(map(len, filled))
    df = Counter(t for w in filled for t in set(w))
    out = []
    for item, text in items:
        scored = []
        for d, w in words:
            if not w:
                continue
            tf, m = Counter(w), 25 + (75 * len(w) * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 8 * m)) for t in plain_terms(text))
            if score > 0:
                scored.append((-score, d is not None, d or 0, d))
        out += [(item, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def got(frame):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in frame.collect()), key=str)


def test_terms():
    for text in ["", None, "A-b c_d É9x.y\t z\x7f\x80", "ÀÉ İ ß 12", "\U0001f600a b"]:
        assert [t.decode() for t in terms(text)] == plain_terms(text)


def test_segment_against_full_sums():
    rnd = random.Random(3)
    for trial in range(60):
        docs, n_terms = rnd.choice([1, 5, 300, 2000]), rnd.choice([1, 4, 30])
        rows = {(t, d): rnd.choice([1, 5, 5, 40, 10**9]) for t in range(n_terms) for d in range(docs) if rnd.random() < rnd.choice([0.02, 0.5, 1])}
        term, doc = np.array([t for t, _ in rows], np.int64), np.array([d for _, d in rows], np.int64)
        segment = Segment(term, doc, np.array(list(rows.values()), np.int64), docs)
        asked = [(t, rnd.randint(1, 3)) for t in range(n_terms + 1) if rnd.random() < 0.8]
        sums = defaultdict(int)
        for t, times in asked:
            for d in range(docs):
                sums[d] += rows.get((t, d), 0) * times
        want = sorted(((s, d) for d, s in sums.items() if s > 0), key=lambda r: (-r[0], r[1]))
        for k in (1, 10):
            assert segment.search(asked, k) == want[:k]
            if len(want) >= k:
                assert segment.search(asked, k, want[k - 1][0]) == want[:k]
                assert segment.search(asked, k, want[0][0] + 1) == []


@pytest.mark.parametrize("segment", [1, 400, 8 << 20])
def test_against_brute_force(spark, monkeypatch, segment):
    monkeypatch.setattr(module, "SEGMENT_BYTES", segment)
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(40)] + ["É", "Straße", "x9"]
    docs = [(i, " ".join(rnd.choice(words[: rnd.choice([5, 43])]) for _ in range(rnd.choice([1, 8, 60])))) for i in range(150)]
    docs += [(900, docs[0][1]), (901, docs[0][1]), (901, docs[0][1]), (902, None), (903, ""), (904, "...!"), (None, docs[3][1]), (905, "W1 " * 20_000)]
    items = [(1, "w1 w2 w2, W3!"), (2, "É straße"), (3, None), (4, "none-such"), (5, docs[0][1]), (6, " ".join(words)), (6, "w7")]
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, score string").repartition(3)
    assert got(ranked_search(d, spark.createDataFrame(items, "item_id long, text string"))) == brute(docs, items)


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(module, "BLOCK_CHARS", 20)
    docs = [(i, f"a{i % 3} b{i % 5} c") for i in range(40)]
    items = [(i, f"a{i % 3} b{i % 7}") for i in range(12)]
    found = ranked_search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert got(found) == brute(docs, items)


def test_empty_tables_and_other_ids(spark):
    docs = spark.createDataFrame([("b", "one two"), ("a", "one two"), ("c", "three")], "doc_id string, text string")
    items = spark.createDataFrame([("q", "one")], "item_id string, text string")
    assert ranked_search(docs.limit(0), items).count() == 0
    assert ranked_search(docs, items.limit(0)).count() == 0
    assert [(r.doc_id, r.rank) for r in ranked_search(docs, items).orderBy("rank").collect()] == [("a", 1), ("b", 2)]
