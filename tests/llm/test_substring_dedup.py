import hashlib
import random
from collections import Counter

from recollect.llm.substring_dedup import merge_intervals, substring_dedup


def brute(texts, size):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + size]) for w in words for i in range(len(w) - size + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i : i + size])] > 1:
                gone.update(range(i, i + size))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def run(spark, texts, size, anchor, ids=None):
    rows = [(i if ids is None else ids[i], t, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, content string")
    got = substring_dedup(df, size=size, anchor=anchor).collect()
    return [(r.n_words, r.n_removed, r.kept_sha256) for r in sorted(got, key=lambda r: r.doc_id)]


def test_against_brute_force(spark):
    rnd = random.Random(3)
    vocab = [f"w{i}" for i in range(12)] + ["é", "a b"]
    texts = [" ".join(rnd.choice(vocab) for _ in range(rnd.randint(0, 60))) for _ in range(40)]
    passage = " ".join(f"p{i}" for i in range(20))
    texts += [f"{t} {passage}\t{u}" for t, u in zip(texts[:6], texts[6:12])]
    texts += ["a a a a a a a a a", "b b b b b b b", "", None, "  \n ", texts[3], texts[3], texts[44] + " z", "one\u000btwo\u001cthree"]
    for size, anchor in ((5, 2), (8, 3), (6, 6), (7, 1)):
        assert run(spark, texts, size, anchor) == brute(texts, size), (size, anchor)


def test_long_text_and_periodic_text(spark):
    rnd = random.Random(5)
    long = " ".join(str(rnd.randint(0, 10**6)) for _ in range(400_000))
    texts = [long, " ".join(["x", "y"] * 30), " ".join(long.split()[1000:1040])]
    assert run(spark, texts, 35, 10) == brute(texts, 35)


def test_empty_table_and_null_ids(spark):
    assert substring_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (1, None)], "doc_id long, text string")
    got = sorted((r.n_words, r.n_removed) for r in substring_dedup(df, size=3, anchor=2).collect())
    assert got == [(0, 0), (4, 4), (4, 4)]


def test_maximal_intervals():
    import numpy as np

    assert merge_intervals(np.array([7, 0, 2, 20]), 5) == [(0, 12), (20, 25)]
