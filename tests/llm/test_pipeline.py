import re
import zlib

import public_tokenizers
import pytest
from test_packing import verify

corpus_pipeline = pytest.importorskip("corpus_pipeline")
DATA = "/root/testdata/sf0.001"


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    items = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    before, columns = docs.collect(), docs.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, DATA).collect(), docs.schema)
        assert docs.columns == columns, name
        seen.append(docs.collect())
    quality, lines, unique, cleaned = seen

    kept = {r.doc_id for r in quality}
    held_out = [i for i in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    right = [(i in kept) == (labels[i] == 1) for i in held_out]
    assert sum(right) / len(right) > max(0.9, sum(labels[i] for i in held_out) / len(held_out))
    assert {r.doc_id: r.text for r in before if r.doc_id in kept} == {r.doc_id: r.text for r in quality}

    holders = {}
    for r in quality:
        for line in r.text.split("\n"):
            key = line.strip(" \t\n\x0b\x0c\r").lower()
            if len(key) >= 20:
                holders.setdefault(key, set()).add(r.doc_id)
    for r, old in zip(sorted(lines, key=lambda r: r.doc_id), sorted(quality, key=lambda r: r.doc_id), strict=True):
        want = [x for x in old.text.split("\n") if len(have := holders.get(x.strip(" \t\n\x0b\x0c\r").lower(), ())) < 3 or r.doc_id == max(have)]
        assert r.text == "\n".join(want) and r.n_chars == len(r.text)

    sets = {r.doc_id: shingles(r.text) for r in lines}
    root = {d: d for d in sets}
    for d in sorted(sets):
        for e in sorted(sets):
            if e < d and sets[d] and 100 * len(sets[d] & sets[e]) >= 80 * len(sets[d] | sets[e]):
                old, new = max(root[d], root[e]), min(root[d], root[e])
                root = {k: new if v == old else v for k, v in root.items()}
    assert {r.doc_id for r in unique} == {d for d in sets if root[d] == d}

    gone = {r.doc_id for r in unique} - {r.doc_id for r in cleaned}
    flat = [" ".join(i.split()).lower() for i in items]
    leaked = {r.doc_id for r in unique if any(i in " ".join(r.text.split()).lower() for i in flat)}
    plain = {d: re.findall(r"[^\W_]+", t.lower()) for d, t in ((r.doc_id, r.text) for r in unique)}
    item_words = [re.findall(r"[^\W_]+", i.lower()) for i in items]
    for d in gone - leaked:  # these hold at least a third of an item's windows of eight words as they are
        held = {tuple(plain[d][i : i + 8]) for i in range(len(plain[d]))}
        assert any(sum(tuple(w[i : i + 8]) in held for i in range(len(w) - 7)) >= (len(w) - 7) / 3 for w in item_words if len(w) > 8), d
    assert leaked <= gone

    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()
    assert verify(pieces, [(r.doc_id, r.text) for r in cleaned], 2048) < 0.05


def test_stages_take_odd_tables(spark):
    """Null and empty texts, repeated and missing ids, an empty table: no stage fails, clean rows stay."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = spark.createDataFrame([(900001, None, None, None, None), (900002, "", "en", "s", 0), (None, "some words of a text", "en", "s", 20), (900003, "the same id", "en", "s", 11), (900003, "the same id again", "en", "s", 17)], docs.schema)
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs.unionByName(odd), DATA)
        assert name == "packing" or got.columns == docs.columns
        assert name == "quality classifier" or {900002, 900003} <= {r.doc_id for r in got.select("doc_id").collect()}, name
        assert stage(spark, docs.limit(0), DATA).count() == 0, name


def test_run(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 0
    assert public_tokenizers.path("word_bpe_49k.json")


def test_a_failed_run_goes_on_where_it_stopped(spark, tmp_path, monkeypatch):
    ran = []

    def stage(name, fails=False):
        def run(spark, docs, sf_dir):
            ran.append(name)
            if fails and ran.count(name) == 1:
                raise RuntimeError(name)
            return docs.limit(0).unionByName(docs.where("doc_id % 2 = 0"))

        return name, run

    monkeypatch.setattr(corpus_pipeline, "STAGES", [stage("a"), stage("b", fails=True), stage("c")])
    folder = str(tmp_path / "run")
    with pytest.raises(RuntimeError):
        corpus_pipeline.run(spark, DATA, folder)
    first = corpus_pipeline.run(spark, DATA, folder)
    assert ran == ["a", "b", "b", "c"]
    assert sorted(r.doc_id for r in first.collect()) == sorted(r.doc_id for r in spark.read.parquet(f"{DATA}/documents.parquet").where("doc_id % 2 = 0").collect())
    corpus_pipeline.run(spark, DATA, folder)
    assert ran == ["a", "b", "b", "c"]
