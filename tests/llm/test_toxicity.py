import random

import numpy as np
from pyspark.sql import functions as F

from recollect.llm import toxicity
from recollect.llm.quality_rules import fold
from recollect.llm.toxicity import WINDOW, Network, fit_network, score_toxicity, train, window_places

DATA = "/root/testdata/sf0.1"  # smaller tables have too few toxic documents to tell a model from a constant
RECALL = 0.7


def test_gradients_by_differences():
    rng = np.random.default_rng(1)
    net = Network.new(np.zeros(1 << 16), np.zeros(1 << 16), 0.1, rng)
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items() if k not in ("word", "gram")}
    table = np.concatenate([rng.standard_normal((7, 10)), np.zeros((1, 10))]).astype(np.float64)
    at = rng.integers(0, 8, (5, 9))
    at[:, 0] = 0
    y = np.array([0, 1, 1, 0, 1])

    def loss():
        p = toxicity._sigmoid(net.forward(table, at).astype(np.float64))
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    g, d_table = net.gradients(table, at, y)
    for k in g:
        flat, i = net.weights[k].reshape(-1), int(rng.integers(net.weights[k].size))
        old, e = flat[i], 1e-2
        flat[i] = old + e
        up = loss()
        flat[i] = old - e
        down = loss()
        flat[i] = old
        assert abs((up - down) / (2 * e) - np.asarray(g[k]).reshape(-1)[i]) < 2e-3, k
    old = table[2, 3]
    table[2, 3] = old + 1e-2
    up = loss()
    table[2, 3] = old - 1e-2
    down = loss()
    table[2, 3] = old
    assert abs((up - down) / 2e-2 - d_table[2, 3]) < 2e-3


def test_windows_cover_every_word():
    first = np.array([0, 0, 1, 49, 97, 400])
    text, start = window_places(first)
    for i in range(5):
        covered = {w for s in start[text == i] for w in range(s, min(s + WINDOW, first[i + 1]))}
        assert covered == set(range(first[i], first[i + 1]))


def test_a_word_deep_in_a_long_text(spark):
    rnd = random.Random(0)
    texts, labels = [], []
    for i in range(400):
        words = [f"w{rnd.randint(0, 300)}" for _ in range(rnd.randint(5, 150))]
        labels.append(i % 5 == 0)
        if labels[-1]:
            words.insert(rnd.randrange(len(words)), rnd.choice(["badword", "badwords", "Badwording"]))
        texts.append(" ".join(words))
    net = fit_network(texts, np.array(labels, dtype=int))
    clean = " ".join(f"w{rnd.randint(0, 300)}" for _ in range(20_000))
    rows = [(1, clean), (2, clean + " badworder"), (3, None), (4, "\n "), (5, "w1 w2 badword"), (6, "x" * 100_000), (5, "w1 w2 badword")]
    df = spark.createDataFrame([(*r, 0.1) for r in rows], "doc_id long, text string, score double")
    got = [r.score for r in score_toxicity(df, net).collect()]
    assert got[0] < 0.5 < got[1] and got[4] > 0.5 and abs(got[4] - got[6]) < 1e-5 and got[2] == got[3] == net.base and 0 <= got[5] <= 1
    assert score_toxicity(df.limit(0), net).count() == 0


def test_constant_without_both_labels():
    net = fit_network(["a b", "c"], np.array([0, 0]))
    assert 0 < net.base < 0.5


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    net = train(docs, labels)
    rows = score_toxicity(docs, net).join(labels, "doc_id").where(fold(F.col("doc_id"), 5) == 0).select("score", "toxic").toPandas()
    right = (rows.score >= 0.5) == (rows.toxic == 1)
    assert right.mean() > max(rows.toxic.mean(), 1 - rows.toxic.mean()) and right[rows.toxic == 1].mean() > RECALL


def plain_score(net, text):
    """Word by word: the n-grams, gates, states and attention of every window, without arrays of windows."""
    words = [w.lower() for w in text.encode().split()]
    words = [w for w in (bytes(x) for x in words)]
    assert all(len(w) <= toxicity.PIECE for w in words)

    def hashed(data, base):
        total = 0
        for i, b in enumerate(data):
            total += b * pow(base, i, 1 << 64)
        return toxicity.mix(np.array([total % (1 << 64)], dtype=np.uint64))

    def slot(h):
        return int(h[0]) >> (64 - toxicity.BITS)

    rows = []
    for w in words:
        word = slot(toxicity.mix(hashed(w, toxicity.BASES[0]) + np.uint64(len(w))))
        marked = b"\x01" + w + b"\x01"
        grams = [slot(toxicity.mix(hashed(marked[i : i + n], toxicity.BASES[1]) + np.uint64(n))) for n in toxicity.GRAMS for i in range(len(marked) - n + 1)]
        rows.append(np.concatenate([[net.word_odds[word], max(net.gram_odds[g] for g in grams)], net.weights["word"][word], np.mean([net.weights["gram"][g] for g in grams], axis=0)]).astype(np.float64))
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    scores = []
    for s in range(0, max(1, len(rows) - WINDOW + toxicity.STRIDE), toxicity.STRIDE):
        window = rows[s : s + WINDOW]
        states = {}
        for d in "fb":
            h, out = np.zeros(toxicity.HIDDEN), []
            for x in window if d == "f" else window[::-1]:
                px, ph, k = x @ net.weights[f"x{d}"] + net.weights[f"c{d}"], h @ net.weights[f"h{d}"], toxicity.HIDDEN
                z, r = sigmoid(px[:k] + ph[:k]), sigmoid(px[k : 2 * k] + ph[k : 2 * k])
                h = (1 - z) * h + z * np.tanh(px[2 * k :] + r * ph[2 * k :])
                out.append(h)
            states[d] = out if d == "f" else out[::-1]
        both = [np.concatenate(x) for x in zip(states["f"], states["b"])]
        energy = np.array([x @ net.weights["attend"] for x in both])
        attention = np.exp(energy - energy.max())
        attention /= attention.sum()
        scores.append(sigmoid(sum(a * x for a, x in zip(attention, both)) @ net.weights["out"] + net.weights["bias"][0]))
    return max(scores)


def test_scores_equal_a_plain_forward_pass(spark):
    rng = np.random.default_rng(5)
    net = Network.new(rng.normal(size=1 << 16), rng.normal(size=1 << 16), 0.2, rng)
    rnd = random.Random(6)
    texts = [" ".join(f"Word{rnd.randint(0, 99)}" for _ in range(n)) for n in (1, 2, 47, 48, 49, 80, 81, 200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in score_toxicity(df, net).collect()}
    assert np.allclose([got[i] for i in range(len(texts))], [plain_score(net, t) for t in texts], atol=1e-5)


def test_repeated_ids_and_empty_tables(spark):
    rows = [(i, ("nice words here " if i % 3 else "awful badword here ") * 3) for i in range(90)]
    docs = spark.createDataFrame(rows + [(1, "zzz"), (2, None)] * 2, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)] + [(None, 1), (4, None)], "doc_id long, toxic int")
    a, b = train(docs, labels), train(docs.orderBy(F.desc("text")), labels)
    assert all((a.weights[k] == b.weights[k]).all() for k in a.weights) and (a.word_odds == b.word_odds).all()
    assert train(docs.limit(0), labels).base == train(docs, labels.limit(0)).base == 0.5


def test_texts_without_blanks_are_read_whole():
    import pyarrow as pa

    from recollect.llm._text import text_buffers

    texts = ["", "x" * 64, "y" * 65, "a " + "z" * 500 + " b", None, "\u8bcd" * 300]
    words = toxicity._steps(*text_buffers(pa.array(texts, pa.large_string())))
    assert (words.ends - words.starts).max() <= 64
    for i, t in enumerate(texts):
        whole = {p for w in range(words.first[i], words.first[i + 1]) for p in range(words.starts[w], words.ends[w] - 7)}
        raw = words.data[words.offsets[i] : words.offsets[i + 1]].tobytes()
        assert whole == {words.offsets[i] + p for p in range(len(raw) - 7) if b" " not in raw[p : p + 8]}, t
    rnd = random.Random(4)
    signs = [chr(0x4E00 + i) for i in range(60)]
    plain = ["".join(rnd.choices(signs, k=rnd.randint(40, 200))) for _ in range(300)]
    labels = np.array([i % 3 == 0 for i in range(300)], dtype=int)
    marked = [t[:35] + "\u9f8d\u9f9c" + t[35:] if y else t for t, y in zip(plain, labels, strict=True)]
    network = fit_network(marked, labels)
    fresh = ["".join(rnd.choices(signs, k=150)) for _ in range(20)]
    scores = [toxicity._scores(network, toxicity._steps(*text_buffers(pa.array(x, pa.large_string())))) for x in (fresh, [t[:120] + "\u9f8d\u9f9c" + t[120:] for t in fresh])]
    assert (scores[1] > scores[0]).all()
