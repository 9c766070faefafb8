"""Joins between queries, memories and facts.  Every pair comes from an equi-join."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions.tokens import tokens
from recollect.operators.shared import cut


def keyword_overlap(queries: DataFrame, memories: DataFrame) -> DataFrame:
    """(query_id, memory_id, overlap, query_size) for all that share a token.

    Both tables have (…_id, text).  A token of a third of all memories is one key:
    adaptive execution splits it, and the sum is pre-aggregated by pair.
    """
    asked = queries.select("query_id", tokens(F.col("text")).alias("words")).select("query_id", F.size("words").alias("query_size"), F.explode("words").alias("word"))
    held = memories.select("memory_id", F.explode(tokens(F.col("text"))).alias("word"))
    return held.join(asked, "word").groupBy("query_id", "memory_id", "query_size").agg(F.count(F.lit(1)).alias("overlap"))


FREQUENT = 1 << 18  # words at most in the list of frequent words
BITS = 1024  # of a set's signature


def token_sets(rows: DataFrame, block: list[str] | None = None) -> DataFrame:
    """(id, block columns, size, rep): the size of every row's token set, and the least id of its block with the same set."""
    block = block or []
    words = F.array_sort(tokens(F.col("text")))
    sets = rows.select("id", *block, F.size(words).alias("size"), F.md5(F.array_join(words, " ").cast("binary")).alias("_key"))
    return sets.withColumn("rep", F.min("id").over(Window.partitionBy(*block, "_key"))).select("id", *block, "size", "rep")


def jaccard_pairs(rows: DataFrame, percent: int, block: list[str] | None = None) -> DataFrame:
    """(a, b, both, size_a, size_b), a < b, with token-set Jaccard >= percent / 100, exactly.

    Equal sets are joined once: pairs are those of different sets, each as its least id, and each
    copy with that id.  So a group of copies grows by its rows, not by its square, and no link is lost.

    Prefix filter: words have one global order, the frequent ones last, the rest by hash; sets that are alike share
    a word among the first n - ceil(t n) + 1 of each, and behind the first one that they share enough
    words must be left.  Which words count as frequent changes the work, never the result.  Only prefixes are shuffled,
    as hashes; signatures (parities of hashed words) bound how much two sets differ, before their words are joined
    and compared.  ``rows`` has (id, text) and the block columns; only rows of one block meet.
    """
    block = block or []
    hashed = rows.select("id", F.xxhash64(F.lit(0), *block).alias("salt"), F.transform(tokens(F.col("text")), lambda w: F.xxhash64(w)).alias("words"))
    kind = dict(rows.dtypes)["id"]
    units = cut(hashed.mapInPandas(_units, f"id {kind}, node long, size long, sig array<long>, word long, times long"))
    counts = units.where("word is not null").groupBy("word").agg(F.sum("times").alias("df"))
    frequent = counts.orderBy(F.desc("df"), "word").limit(FREQUENT).toPandas().sort_values("word")
    shared = rows.sparkSession.sparkContext.broadcast((frequent["word"].to_numpy(), frequent["df"].to_numpy()))
    signed = units.where("word is null").select("id", "node", "size", "sig")
    # of equal sets the least id stays
    prefix = hashed.mapInPandas(_prefixes(shared, percent), f"id {kind}, node long, size long, key long, rank long, s0 long, s1 long").repartition("key")
    prefix = prefix.groupBy("key", "node", "size", "rank", "s0", "s1").agg(F.min("id").alias("id"))
    right = prefix.select("key", *[F.col(c).alias(f"_{c}") for c in ("node", "size", "rank", "s0", "s1", "id")])
    sizes = F.col("size") + F.col("_size")
    left = 1 + F.least(F.col("size") - F.col("rank"), F.col("_size") - F.col("_rank"))
    differ = F.bit_count(F.col("s0").bitwiseXOR(F.col("_s0"))) + F.bit_count(F.col("s1").bitwiseXOR(F.col("_s1")))
    near = (F.least("size", "_size") * 100 >= F.greatest("size", "_size") * percent) & (left * (100 + percent) >= percent * sizes)
    near = near & (differ * (100 + percent) <= (100 - percent) * sizes) & (F.col("node") != F.col("_node"))
    met = prefix.join(right, "key").where((F.col("id") < F.col("_id")) & near).select(F.col("id").alias("a"), F.col("_id").alias("b")).distinct()
    met = met.join(signed.select(F.col("id").alias("a"), F.col("size").alias("size_a"), F.col("sig").alias("sig_a")), "a").join(signed.select(F.col("id").alias("b"), F.col("size").alias("size_b"), F.col("sig").alias("sig_b")), "b")
    differ = F.aggregate(F.zip_with("sig_a", "sig_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    met = cut(met.where(differ * (100 + percent) <= (100 - percent) * (F.col("size_a") + F.col("size_b"))).select("a", "b"))
    some = met.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    held = cut(rows.join(some, "id", "left_semi").select("id", *block, tokens(F.col("text")).alias("words")))
    ends = [held.select(F.col("id").alias(x), F.col("words").alias(f"words_{x}"), F.struct(F.lit(0), *block).alias(f"_{x}")) for x in "ab"]
    pairs = met.join(ends[0], "a").join(ends[1], "b").where("_a <=> _b")
    found = pairs.select("a", "b", F.size(F.array_intersect("words_a", "words_b")).alias("both"), F.size("words_a").alias("size_a"), F.size("words_b").alias("size_b"))
    found = found.where(F.col("both") * 100 >= percent * (F.col("size_a") + F.col("size_b") - F.col("both")))
    same = signed.withColumn("rep", F.min("id").over(Window.partitionBy("node", F.get("sig", F.lit(0))))).where("id <> rep")
    copies = same.select(F.col("rep").alias("a"), F.col("id").alias("b"), *[F.col("size").cast("int").alias(c) for c in ("both", "size_a", "size_b")])
    return found.unionByName(copies)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashed_sets(batches):
    """(rows, sizes, row of each word, words, mixed words, hash of each set, signatures) of at most 2000 sets of hashed words that are not empty."""
    for some in batches:
        some = some[some["words"].map(len) > 0]
        for at in range(0, len(some), 2000):
            batch = some.iloc[at : at + 2000]
            n = batch["words"].map(len).to_numpy().astype(np.int64)
            words = np.concatenate(batch["words"].to_numpy()).astype(np.int64)
            row = np.repeat(np.arange(len(n)), n)
            mixed = _mix(words.view(np.uint64))
            salt = _mix(batch["salt"].to_numpy().astype(np.int64).view(np.uint64))
            sums = np.add.reduceat(_mix(mixed + np.uint64(0x9E3779B97F4A7C15)), np.cumsum(n) - n)
            bits = np.bincount(row * BITS + (mixed % np.uint64(BITS)).astype(np.int64), minlength=len(n) * BITS).reshape(len(n), BITS) & 1
            sig = np.packbits(bits.astype(bool), axis=1).view(np.int64)
            yield batch, n, row, words, (mixed ^ salt[row]).view(np.int64), (sums ^ _mix(n.astype(np.uint64) + salt)).view(np.int64), sig


def _units(batches):
    """A row for each set with its hash and signature, and the words that several of 2000 sets hold, with their count."""
    for batch, n, _, words, _, node, sig in _hashed_sets(batches):
        none = pd.array([pd.NA] * len(n), "Int64")
        yield pd.DataFrame({"id": batch["id"].to_numpy(), "node": node, "size": n, "sig": list(sig), "word": none, "times": none})
        word, times = np.unique(words, return_counts=True)
        word, times = word[times > 1], times[times > 1]
        none = pd.array([pd.NA] * len(word), "Int64")
        yield pd.DataFrame({"id": none, "node": none, "size": none, "sig": None, "word": word, "times": times})


def _prefixes(shared, percent: int):
    """The prefix of each set, a row a word with its key and rank."""

    def run(batches):
        listed, times = shared.value
        for batch, n, row, words, keys, node, sig in _hashed_sets(batches):
            df = np.zeros(len(words), np.int64)
            if len(listed):
                place = np.minimum(np.searchsorted(listed, words), len(listed) - 1)
                df = np.where(listed[place] == words, times[place], 0)
            order = np.lexsort((words, df, row))
            rank = np.arange(len(words)) - np.repeat(np.cumsum(n) - n, n) + 1
            keep = rank <= np.repeat(n - (n * percent + 99) // 100 + 1, n)
            fold = np.bitwise_xor.reduce(sig.reshape(len(n), -1, 2), axis=1)
            r = row[keep]
            yield pd.DataFrame({"id": batch["id"].to_numpy()[r], "node": node[r], "size": n[r], "key": keys[order][keep], "rank": rank[keep], "s0": fold[r, 0], "s1": fold[r, 1]})

    return run


def validity(facts: DataFrame, keys: list[str], at: str, order: list[str]) -> DataFrame:
    """Facts with valid_from and valid_until: each holds until the key's next fact."""
    line = Window.partitionBy(*keys).orderBy(*order)
    return facts.withColumn("valid_from", F.col(at)).withColumn("valid_until", F.lead(at).over(line))


def state_as_of(facts: DataFrame, keys: list[str], at: str, order: list[str], when: Column) -> DataFrame:
    """The fact of every key that holds at ``when``."""
    rows = validity(facts, keys, at, order)
    return rows.where((F.col("valid_from") <= when) & (F.col("valid_until").isNull() | (F.col("valid_until") > when)))


def supersede_chain(facts: DataFrame, keys: list[str], value: str, order: list[str], key: str = "fact_id") -> DataFrame:
    """History of an exclusive predicate: repeats drop, each new value closes the one before."""
    line = Window.partitionBy(*keys).orderBy(*order)
    changed = facts.withColumn("_before", F.lag(value).over(line)).where(F.col("_before").isNull() | (F.col("_before") != F.col(value))).drop("_before")
    linked = changed.withColumns({"supersedes": F.lag(key).over(line), "superseded_by": F.lead(key).over(line)})
    return linked.withColumn("is_current", F.col("superseded_by").isNull())


def vector_knn(queries: DataFrame, vectors: DataFrame, k: int, least: float, max_queries: int | None = None, block: int = 10_000) -> DataFrame:
    """(query_id, vec_id, similarity, rank): the k nearest by cosine of every query.

    The vectors stream past the broadcast queries; each task keeps its own best k a
    query, so what is shuffled does not grow with queries times vectors.  Queries
    are dealt by hash of the id into blocks of about ``block``, so the vectors are
    read once a block and only one block is in a task's memory.  Only a caller who
    gives ``max_queries`` has more than that refused.
    """
    asked = queries.select("query_id", "embedding")
    count = asked.count()
    if max_queries is not None and count > max_queries:
        raise ValueError(f"over {max_queries} queries")
    blocks = max(1, -(-count // block))

    def near(number: int) -> DataFrame:
        some = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == number).toPandas()
        ids = some["query_id"].to_numpy()
        q = np.array(some["embedding"].tolist(), dtype=np.float64).reshape(len(some), -1)
        q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12)
        shared = vectors.sparkSession.sparkContext.broadcast((ids, q))

        def best(batches):
            ids, q = shared.value
            kept = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "similarity": pd.Series(dtype="float64")})
            for batch in batches:
                if batch.empty or not len(ids):
                    continue
                v = np.array(batch["embedding"].tolist(), dtype=np.float64)
                v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
                step = max(1, 2_000_000 // len(ids))  # of at most 16 MB of similarities
                for at in range(0, len(v), step):
                    i, j = np.nonzero((s := q @ v[at : at + step].T) >= least)
                    kept = pd.concat([kept, pd.DataFrame({"query_id": ids[i], "vec_id": batch["vec_id"].to_numpy()[at + j], "similarity": s[i, j]})])
                    kept = kept.sort_values(["query_id", "similarity", "vec_id"], ascending=[True, False, True]).groupby("query_id").head(k)
            yield kept

        return vectors.select("vec_id", "embedding").mapInPandas(best, "query_id long, vec_id long, similarity double")

    found = reduce(DataFrame.unionByName, [near(number) for number in range(blocks)])
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")))
    return ranked.where(F.col("rank") <= k)
