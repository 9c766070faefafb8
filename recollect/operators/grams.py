"""Words that hold other words, found through an index of their trigrams; equi-joins only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.functions import questions
from recollect.functions.tokens import word_tokens
from recollect.operators.shared import cut
from recollect.operators.sparse import sparse_top


def grams(word: Column, n: int) -> Column:
    """The runs of ``n`` characters of a word, each once; none of shorter words."""
    last = F.length(word) - (n - 1)
    return F.when(last >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(word, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def words_holding(sought: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(part, word): the words of ``vocabulary`` (word) that hold a ``part`` anywhere inside.

    A part is looked up by the one of its trigrams that fewest words have, and what the posting gives is
    verified; so no part meets all words.  Parts of one or two characters have postings of their own.
    Null and empty parts find nothing.
    """
    words = vocabulary.select("word").distinct()
    posted = words.select("word", F.explode(F.concat(*[grams(F.col("word"), n) for n in (1, 2, 3)])).alias("gram"))
    counts = posted.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    own = F.when(F.length("part") >= 3, grams(F.col("part"), 3)).otherwise(F.array("part"))
    parts = sought.select("part").where("part <> ''").distinct().select("part", F.explode(own).alias("gram"))
    # a part with a gram that no word has is held by none
    weighed = parts.join(counts, "gram", "left").na.fill(0, ["n"])
    rare = weighed.groupBy("part").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    return posted.join(rare, "gram").where(F.contains("word", "part")).select("part", "word")


def search_inside(asked: DataFrame, turns: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, memory_id, score, rank): for each keyword of a question 1 if a turn holds it anywhere, .5 more if as a whole word.

    ``asked`` are (query_id, text), ``turns`` (memory_id, text).  A keyword has no blanks, so a turn holds it if one of
    its words does: keywords are looked up in the vocabulary, and the turns get them through their words.
    """
    sought = asked.select("query_id", questions.search_keywords(F.col("text")).alias("words"))
    keywords = sought.select(F.explode("words").alias("part")).distinct()
    said = cut(turns.select("memory_id", F.explode(F.array_distinct(word_tokens(F.col("text")))).alias("word")))
    held = words_holding(keywords, said)
    met = said.join(held, "word").groupBy("memory_id", "part").agg(F.max(F.when(F.col("word") == F.col("part"), 1.5).otherwise(1.0)).alias("weight"))
    keys = met.groupBy("memory_id").agg(F.collect_list(F.struct(F.col("part").alias("key"), "weight")).alias("keys"))
    ones = F.transform("words", lambda w: F.struct(w.alias("key"), F.lit(1.0).alias("weight")))
    return sparse_top(sought.select("query_id", ones.alias("keys")), keys, k)
