import hashlib
import random

import numpy as np
import pytest

from recollect.llm.imatch import BITS, RATES, Fingerprinter, compare_with_edits, fingerprints, lexicon, likeness, subset_factors
from recollect.llm._text import Words


def slot(word, bits=BITS):
    return int.from_bytes(hashlib.md5(word).digest()[:4], "big") >> (32 - bits)


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode()


def brute_lexicon(texts, low=0.15, high=0.9, bits=BITS):
    df = {}
    for t in texts:
        for w in set(lower(t).split()):
            df[slot(w, bits)] = df.get(slot(w, bits), 0) + 1
    n = float(len(texts))
    return {s for s, c in df.items() if n ** (1 - high) <= c <= n ** (1 - low)}


def brute_print(text, kept, bits=BITS):
    terms = sorted(set(lower(text).split()))
    terms = [w for w in terms if slot(w, bits) in kept] or terms
    digest = lambda x: f"{sum(int.from_bytes(hashlib.md5(w).digest()[4:8], 'big') for w in x) % 2**32:08x}"
    subsets = [[w for w in terms if (a * slot(w, bits) + b) % (2**31 - 1) % rate == 0] for (a, b), rate in zip(subset_factors(), RATES)]
    return [digest(terms), *map(digest, subsets)]


def brute_likeness(a, b):
    some = [(x, y) for x, y in zip(a[1:], b[1:]) if int(x, 16) or int(y, 16)]
    return 1.0 if a == b else sum(x == y for x, y in some) / max(1, len(some))


def corpus(n=60):
    rnd = random.Random(5)
    return [" ".join(rnd.choice(["the", "Alpha", "beta"] + [f"t{i}" for i in range(200)]) for _ in range(rnd.randint(0, 90))) for _ in range(n)]


def test_against_brute_force(spark):
    texts = corpus() + ["", None, "unique words only", "ÄÖ é", "x" * 100_000]
    ids = random.Random(1).sample(range(10_000), len(texts))
    df = spark.createDataFrame([(i, t, 1) for i, t in zip(ids, texts)], "doc_id long, text string, slot int")
    kept = lexicon(df)
    assert set(np.flatnonzero(np.unpackbits(kept)).tolist()) == brute_lexicon(texts)
    want = {i: brute_print(t, brute_lexicon(texts)) for i, t in zip(ids, texts)}
    assert {r.doc_id: r.fingerprint for r in fingerprints(df, kept).collect()} == {i: " ".join(p) for i, p in want.items()}
    rows = sorted(zip(ids, texts))
    got = {r.doc_id: r for r in compare_with_edits(df, kept, ranges=7).collect()}
    assert len(got) == len(rows)
    for (i, t), (j, u) in zip(rows, rows[1:] + rows[:1]):
        t, u = t or "", u or ""
        edited = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
        p = brute_print(edited, brute_lexicon(texts))
        r = got[i]
        assert (r.n_chars, r.edited_sha256, r.edited_fingerprint) == (len(t), hashlib.sha256(edited.encode()).hexdigest(), " ".join(p))
        assert r.near_edited == brute_likeness(want[i], p) and r.near_next == brute_likeness(want[i], want[j])


def test_ties_nulls_and_small_tables(spark):
    shape = "doc_id long, text string"
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c d e f"), (None, None), (2, "z")], shape)
    assert compare_with_edits(df, lexicon(df)).count() == 5
    one = spark.createDataFrame([(1, "a b c d")], shape)
    r = compare_with_edits(one, lexicon(one)).first()
    assert r.near_next == 1 and r.n_chars == 7
    none = one.limit(0)
    assert compare_with_edits(none, lexicon(none)).count() == fingerprints(none, lexicon(none)).count() == 0


@pytest.mark.parametrize("bits", [19, 26])
def test_width_of_the_lexicon(spark, bits):
    texts = corpus(20)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = lexicon(df, bits=bits)
    assert len(kept) == 1 << bits - 3 and set(np.flatnonzero(np.unpackbits(kept)).tolist()) == brute_lexicon(texts, bits=bits)
    assert {r.doc_id: r.fingerprint for r in fingerprints(df, kept).collect()} == {i: " ".join(brute_print(t, brute_lexicon(texts, bits=bits), bits)) for i, t in enumerate(texts)}


def test_likeness_orders_edits():
    printer = Fingerprinter(np.full(1 << BITS - 3, 255, dtype=np.uint8))
    rnd = random.Random(2)
    a, b = ([f"w{rnd.randint(0, 10**6)}" for _ in range(150)] for _ in range(2))
    texts = [" ".join(x).encode() for x in (a, a[:75] + b[:75], b, a[:140])]
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    p = printer.of(Words(data, np.concatenate([[0], np.cumsum([len(t) for t in texts])])))
    near = likeness(np.repeat(p[:1], 4, axis=0), p)
    assert near[0] == 1 > near[3] > near[1] > near[2]
