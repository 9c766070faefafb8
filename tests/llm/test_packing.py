import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from recollect.llm.packing import OpenWindows, pack

PATH = public_tokenizers.path("word_bpe_49k.json")


def verify(rows, texts, size):
    """rows: of pack; texts: (doc_id, text).  Returns the share of padding."""
    whole = Tokenizer.from_file(PATH)
    want = defaultdict(list)
    for d, t in texts:
        want[d].append(np.array([*whole.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4"))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert 0 < r.length <= size
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for d, docs in want.items():
        if len(docs) > 1:
            continue
        at = 0
        for r in sorted(pieces[d], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(docs[0])
            assert zlib.crc32(docs[0][at : at + r.length].tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(docs[0])
    assert sum(r.length for r in rows) == sum(len(x) for docs in want.values() for x in docs)
    padding = 0
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
        padding += size - at
    return padding / (len(sequences) * size)


def test_pieces(spark):
    rnd = random.Random(1)
    texts = [(i, " ".join(rnd.choice(["cat", "dogs", "unbelievable", "xyzzy"]) for _ in range(rnd.randint(0, 400)))) for i in range(400)]
    texts += [(1000, None), (1001, ""), (1002, "long " * 30_000), (1003, "x"), (1003, "x"), (None, "y z")]
    df = spark.createDataFrame([(*t, 5) for t in texts], "doc_id long, text string, start int").repartition(3)
    rows = pack(df, PATH, 1, size=256, open_windows=8).collect()
    assert verify(rows, texts, 256) < 0.02
    assert pack(df.limit(0), PATH, 1).count() == 0


def test_windows_stay_few():
    packer = OpenWindows(100, 4, 10)
    rnd = random.Random(2)
    for i in range(500):
        packer.add(i, rnd.randint(1, 250))
        assert len(packer.windows) <= 4
    assert all(sum(p[2] for p in w) > 90 for w in packer.done)
