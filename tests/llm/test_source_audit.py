import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from recollect.llm import source_audit as module
from recollect.llm.source_audit import encode, run_sum, source_divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, least, most):
    held, count, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in docs:
        words = [t.translate(LOWER) for t in TERM.findall(text or "")]
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        held[lang].update(set(words))
        count[lang, source].update(words)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in held[lang].items() if n >= least]
        whole = Counter()
        for s in sources:
            whole.update(count[lang, s])
        share = lambda c: {t: 1 + (10**9 * (c[t] + 2)) // (sum(c[x] for x in kept) + 2 * len(kept)) for t in kept}
        p, q = {s: share(count[lang, s]) for s in sources}, share(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            named = [(-f(p[s][t], q[t]), t.encode(), t) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, rows in (("pair", sorted(pairs)), ("term", sorted(named)[:most])):
                out += [(lang, s, part, item, -v, i) for i, (v, _, item) in enumerate(rows, 1)]
    return sorted(out)


def got(frame):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r.rank) for r in frame.collect())


def test_runs():
    rnd = random.Random(1)
    for n in (1, 2, 50):
        for _ in range(50):
            columns = [[rnd.choice([0, 0, 0, 1, 1, 7]) for _ in range(n)] for _ in range(2)]
            coded = []
            for column in columns:
                places = np.array([i for i, x in enumerate(column) if x], dtype=np.int64)
                counts, lengths = encode(places, np.array([column[i] for i in places], dtype=np.int64), n)
                assert np.repeat(counts, lengths).tolist() == column
                assert (np.diff(counts) != 0).all()
                coded.append((counts + 1, np.cumsum(lengths)))
            want = sum((a - b) ** 2 // (a + b + 2) for a, b in zip(*columns, strict=True))
            assert run_sum(*coded[0], *coded[1]) == want


@pytest.mark.parametrize(("cells", "terms", "tile", "held"), [(1_000_000, 100_000, 64, 300_000), (5, 3, 2, 7)])
def test_against_brute_force(spark, monkeypatch, cells, terms, tile, held):
    for name, value in (("CHUNK_CELLS", cells), ("CHUNK_TERMS", terms), ("TILE", tile), ("HELD", held)):
        monkeypatch.setattr(module, name, value)
    rnd = random.Random(4)
    words = [f"{c}{d}" for c in "abcdefgh" for d in ("x", "É", "Y", "zz")]
    docs = [(" ".join(rnd.choice(words[: rnd.choice([4, 32])]) for _ in range(rnd.choice([0, 3, 30]))), rnd.choice(["en", "en", "de"]), f"s{rnd.randint(0, 7)}") for _ in range(160)]
    docs += [docs[0]] * 5 + [(None, "en", None), ("", "fr", "empty"), ("1 2 3", "fr", "other"), ("a-b.c", None, "s1"), ("ax " * 30_000, "de", "s1"), ("rare words", "en", "lonely")]
    frame = spark.createDataFrame([(i, *d, 1) for i, d in enumerate(docs)], "doc_id long, text string, lang string, source string, value int").repartition(3)
    assert got(source_divergence(frame, least=3, most=4)) == brute(docs, 3, 4)


def test_empty_table_and_no_kept_terms(spark):
    frame = spark.createDataFrame([("a b", "en", "x"), ("c", "en", "y")], "text string, lang string, source string")
    assert source_divergence(frame.limit(0)).count() == 0
    assert got(source_divergence(frame)) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]
