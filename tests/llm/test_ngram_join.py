import random

import pytest
from pyspark.sql import functions as F

import recollect.llm.ngram_join as ngram_join
from recollect.llm.ngram_join import _band, ngram_jaccard_components


def shingles(text, k=5):
    words = tuple("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split())
    if not words:
        return frozenset()
    return frozenset(words[i : i + k] for i in range(len(words) - k + 1)) or frozenset([words])


def brute(rows, percent=80):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows))


def run(spark, rows):
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, node int")
    return sorted(tuple(r) for r in ngram_jaccard_components(df).collect())


def corpus(rnd, bases=20, copies=6, length=40):
    texts = []
    for _ in range(bases):
        base = [f"w{rnd.randint(0, 400)}" for _ in range(rnd.randint(3, length))]
        for _ in range(rnd.randint(1, copies)):
            words = list(base)
            for _ in range(rnd.randint(0, 3)):
                words[rnd.randrange(len(words))] = f"w{rnd.randint(0, 400)}"
            if rnd.random() < 0.3:
                words = words[rnd.randint(0, 4) :]
            texts.append(" ".join(words))
    return texts


def test_against_brute_force(spark, monkeypatch):
    rnd = random.Random(8)
    texts = corpus(rnd) + ["", None, "  \t", "one", "One", "one two", "a b c d e", "A\nb c\td e", "a a a a a a a", "a a a a a"]
    ids = rnd.sample(range(1000), len(texts))
    rows = list(zip(ids, texts))
    assert run(spark, rows) == brute(rows)
    monkeypatch.setattr(ngram_join, "SMALL_BLOCK", 2)
    monkeypatch.setattr(ngram_join, "TILE", 3)
    assert run(spark, rows) == brute(rows)


def test_sizes_at_the_edge_of_their_bands(spark, monkeypatch):
    """Sets of 4 / 5 of each other's size, some bands apart, in groups of many tiles."""
    monkeypatch.setattr(ngram_join, "SMALL_BLOCK", 2)
    monkeypatch.setattr(ngram_join, "TILE", 4)
    base = [f"b{i}" for i in range(160)]
    lengths = [16, 20, 25, 31, 32, 40, 50, 63, 64, 80, 100, 125, 128, 156, 160]
    rows = [(10 * i + c, " ".join([*base[: n + 4], *([] if c < 3 else [f"x{i}{c}"])])) for i, n in enumerate(lengths) for c in range(4)]
    assert run(spark, rows) == brute(rows)
    got = {d: c for d, _, c in run(spark, [(i, " ".join(base[: n + 4])) for i, n in enumerate((64, 80, 100, 126))])}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3}


@pytest.mark.parametrize("percent", [1, 37, 80, 99, 100])
def test_bands_keep_near_sizes_beside_each_other(spark, percent):
    n = 1500 if percent > 1 else 400
    bands = [r.b for r in spark.range(1, n + 1).select(_band(F.col("id"), percent).alias("b")).collect()]
    assert all(bands[-(-percent * y // 100) - 1] >= bands[y - 1] - 1 for y in range(1, n + 1)) and bands == sorted(bands)


def test_long_sets_of_several_signature_widths(spark):
    rnd = random.Random(6)
    rows = []
    for g, length in enumerate((500, 1000, 1020, 2100, 5000)):
        base = [f"g{g}_{rnd.randint(0, 10**6)}" for _ in range(length)]
        for c in range(4):
            words = base[: length - rnd.randint(0, length // 6)]
            words[rnd.randrange(len(words))] = "x"
            rows.append((10 * g + c, " ".join(words)))
    rows += [(100 + i, " ".join(["p"] * 20 + [f"q{i}_{j}" for j in range(2000)])) for i in range(40)]
    assert run(spark, rows) == brute(rows)


def test_large_group_and_shared_passage(spark):
    rnd = random.Random(4)
    base = [f"b{i}" for i in range(120)]
    passage = [f"p{i}" for i in range(30)]
    rows = []
    for i in range(150):
        words = list(base)
        words[rnd.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(words)))
    rows += [(200 + i, " ".join([*(f"u{i}_{j}" for j in range(20)), *passage])) for i in range(120)]
    assert run(spark, rows) == brute(rows)


def test_ids_that_repeat_or_lack(spark):
    df = spark.createDataFrame([(7, "a b c d e f"), (7, "a b c d e f"), (7, "other words"), (None, "a b c d e f"), (None, "alone here")], "doc_id long, text string")
    got = sorted(map(str, (tuple(r) for r in ngram_jaccard_components(df).collect())))
    assert got == sorted(map(str, [(7, 2, 7), (7, 2, 7), (7, 1, 7), (None, 2, 7), (None, 1, None)]))
    assert ngram_jaccard_components(df.limit(0)).count() == 0
