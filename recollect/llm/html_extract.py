"""Main text of web pages by the consensus of each host.

Pages of one host share templates.  A first pass scores every page's containers and
gives one vote to the generalised path (tags with classes, digits as ``#``) of the
best; Spark counts votes per host and path and ranks each host's paths.  A second
pass takes from every page what stands under the first of its host's paths that
the page has, so a page that misleads the score is read like its neighbours; a
page with none of them is read by its own best container.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.llm._html import best_container, parse, text_under
from recollect.llm._shared import cut

LEAST_SHARE = 0.05  # of a host's votes, for a path that wins; so a host has twenty at most
BROADCAST_CHARS = 4_000_000  # of hosts and paths that are broadcast; beyond, pages and paths are shuffled by host
SALTS = 32
OUT_CHARS = 4 << 20


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without it."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, path, votes) of a task's pages; a page without text does not vote."""
    votes: Counter = Counter()
    for batch in batches:
        hosts, pages = batch.columns
        for i in range(len(batch)):
            page = parse(pages[i].as_py())
            if page.blocks:
                votes[hosts[i].as_py(), page.paths[best_container(page)]] += 1
        if len(votes) > 100_000:
            yield _vote_rows(votes)
            votes.clear()
    yield _vote_rows(votes)


def _vote_rows(votes: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([h for h, _ in votes], pa.string()), pa.array([p for _, p in votes], pa.string()), pa.array(list(votes.values()), pa.int64())], names=["host", "path", "votes"])


def main_text(html: str | None, paths: list[str]) -> str:
    """What stands under the first of ``paths`` that the page has, else under its best container."""
    page = parse(html)
    if not page.blocks:
        return ""
    have = set(page.paths)
    for path in paths:
        if path in have:
            text = text_under(page, {i for i, p in enumerate(page.paths) if p == path})
            if text:
                return text
    return text_under(page, {best_container(page)})


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, urls, pages, paths = batch.columns
        first, texts, chars = 0, [], 0
        for i in range(len(batch)):
            texts.append(main_text(pages[i].as_py(), paths[i].as_py() or []))
            chars += len(texts[-1])
            if chars >= OUT_CHARS or i == len(batch) - 1:
                yield pa.RecordBatch.from_arrays([ids[first : i + 1], urls[first : i + 1], pa.array(texts, pa.string())], names=["page_id", "url", "text"])
                first, texts, chars = i + 1, [], 0


def host_paths(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, path, votes, rank): the paths that win at least ``LEAST_SHARE`` of a host's votes.

    Rank 1 has the most votes; equal ones rank by path.  Pages without a host vote
    together under the empty host.
    """
    votes = pages.select(host_of(F.col(url)).alias("host"), F.col(html).alias("html")).mapInArrow(_votes, "host string, path string, votes long")
    votes = votes.groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    votes = cut(votes)
    totals = votes.groupBy("host").agg(F.sum("votes").alias("all"))
    # the share comes first, so a host of very many paths has a few rows in its window
    won = votes.join(totals, "host").where(F.col("votes") >= F.col("all") * LEAST_SHARE).drop("all")
    return won.withColumn("rank", F.row_number().over(Window.partitionBy("host").orderBy(F.desc("votes"), "path")))


def extract_main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page.

    ``text`` are the blocks of the main container in page order, joined by one
    space, character references decoded and white space (as Python's ``str.split`` has it) inside a block turned into
    one space; empty if there are none.  Menus, page headers, footers, sidebars, notices,
    adverts, forms, scripts, styles and reader comments are left out, told by
    element, role, class or id.  ``n_chars`` counts code points.

    A null or empty page has an empty text.  Rows are read one by one, so repeated
    rows repeat (and vote as often); a null page_id or url is kept.  Empty tables give
    an empty result; other columns are not read.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    won = cut(host_paths(rows).groupBy("host").agg(F.sort_array(F.collect_list(F.struct("rank", "path"))).alias("paths")).select("host", F.col("paths.path").alias("paths")))
    chars = won.agg(F.sum(F.length("host") + F.length(F.concat_ws("", "paths")) + 50)).first()[0] or 0
    rows = rows.withColumn("host", host_of(F.col("url")))
    if chars <= BROADCAST_CHARS:
        rows = rows.join(F.broadcast(won), "host", "left")
    else:  # a large host's pages are dealt to SALTS parts, each with a copy of its few paths
        salted = won.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("_salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["host", "_salt"], "left")
    kind = dict(rows.dtypes)["page_id"]
    found = rows.select("page_id", "url", "html", "paths").mapInArrow(_extracted, f"page_id {kind}, url string, text string")
    return found.withColumn("n_chars", F.length("text").cast("long"))
