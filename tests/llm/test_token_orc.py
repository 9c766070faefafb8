import glob
import random
import zlib

import numpy as np
import public_tokenizers
from pyarrow import orc
from tokenizers import Tokenizer

from recollect.llm.token_orc import read_tokens, tokens_of, write_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_round_trip(spark, tmp_path):
    rnd = random.Random(4)
    rows = [(i * 3, " ".join(rnd.choice(["cat", "dog.", "Zebra", "\n", "naïve"]) for _ in range(rnd.randint(0, 80)))) for i in range(300)]
    rows += [(5000, None), (5001, ""), (5002, "word " * 50_000)]
    rnd.shuffle(rows)
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, ids int").repartition(5)
    write_tokens(df, str(tmp_path / "t"), PATH, 2)
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in read_tokens(spark, str(tmp_path / "t")).collect())
    whole, start, want = Tokenizer.from_file(PATH), 0, []
    for d, t in sorted(rows, key=lambda r: r[0]):
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
    one = tokens_of(spark, str(tmp_path / "t"), [5001]).collect()
    assert [(r.doc_id, r.ids) for r in one] == [(5001, [2])]
    files = sorted(glob.glob(str(tmp_path / "t" / "part-*")))
    at = [x for f in files for x in orc.ORCFile(f).read(columns=["doc_id"])["doc_id"].to_pylist()]
    assert at == sorted(at)


def test_repeated_and_missing_ids(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b"), (1, "c"), (None, "x y z"), (0, None)], "doc_id long, text string")
    write_tokens(df, str(tmp_path / "t"), PATH, 2)
    rows = sorted(read_tokens(spark, str(tmp_path / "t")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, 0, 1, 1]
    assert [r.start for r in rows] == np.cumsum([0, *(r.n_tokens for r in rows)])[:-1].tolist()


def test_empty_table(spark, tmp_path):
    write_tokens(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "t"), PATH, 2)
    assert read_tokens(spark, str(tmp_path / "t")).count() == 0
