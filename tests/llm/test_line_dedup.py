import hashlib
import random

from recollect.llm.line_dedup import keeps, line_dedup

BLANK = " \t\n\x0b\x0c\r"


def brute(rows, min_chars=20, min_docs=3):
    def key(line):
        return line.strip(BLANK).encode().lower()

    docs = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(line.strip(BLANK)) >= min_chars:
                docs.setdefault(key(line), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = []
        for line in lines:
            have = docs.get(key(line), ()) if len(line.strip(BLANK)) >= min_chars else ()
            keep.append(len(have) < min_docs or i == max(have, key=lambda x: -1 if x is None else x))
        kept = "\n".join(x for x, k in zip(lines, keep) if k)
        out.append((i, len(lines), len(lines) - sum(keep), hashlib.sha256(kept.encode()).hexdigest(), tuple(keep)))
    return sorted(out, key=str)


def run(spark, rows, **more):
    df = spark.createDataFrame([(i, t, "line") for i, t in rows], "doc_id long, text string, line string")
    got = line_dedup(df, digest=True, **more).collect()
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256, tuple(keeps(r.keep_bitmap, r.n_lines).tolist())) for r in got), key=str)


def test_against_brute_force(spark):
    rnd = random.Random(1)
    pool = [f"Line number {i} " + "x" * rnd.randint(0, 12) for i in range(30)] + ["short", "", "Ünïcode línë here", " padded with a hard blank "]
    rows = []
    for i in range(60):
        lines = [rnd.choice(pool) for _ in range(rnd.randint(0, 9))]
        lines = [x.upper() if rnd.random() < 0.2 else f"\t{x} \r" if rnd.random() < 0.2 else x for x in lines]
        rows.append((i, "\n".join(lines)))
    rows += [(100, None), (101, ""), (102, "\n\n"), (None, pool[3] + "\n" + pool[4]), (None, pool[3]), (5, pool[5]), (5, rows[5][1])]
    assert run(spark, rows) == brute(rows)


def test_a_line_in_every_document_spans_partitions(spark):
    rows = [(i, f"a line that every document holds\nown line of document number {i:05d}") for i in range(3000)]
    got = run(spark, rows)
    assert got == brute(rows)
    assert sum(r[2] for r in got) == 2999


def test_two_documents_are_too_few(spark):
    rows = [(1, "exactly twenty chars\nb"), (2, "EXACTLY TWENTY CHARS"), (3, "exactly twenty char"), (3, "exactly twenty char")]
    assert [r[2] for r in run(spark, rows)] == [0, 0, 0, 0]
    assert sum(r[2] for r in run(spark, [*rows, (4, "exactly twenty chars")])) == 2


def test_empty_table_and_carried_columns(spark):
    assert line_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([(1, "a", "en")], "doc_id long, text string, lang string")
    assert line_dedup(df, keep_text=True, carry=("lang",)).first().lang == "en"


def test_carried_names_must_not_clash(spark):
    import pytest

    df = spark.createDataFrame([(1, "a", 5)], "doc_id long, text string, n_lines int")
    with pytest.raises(ValueError):
        line_dedup(df, carry=("n_lines",))
