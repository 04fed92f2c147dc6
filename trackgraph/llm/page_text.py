"""Main texts of web pages by removal of site templates.

The subtrees of every page are hashed, counted for each host in Spark, and those that recur on many different pages of a host are
deleted from its pages; marks (names of elements, roles, classes) tell menus, adverts and the like that differ from page to page.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from trackgraph.functions.storage import scratch, staged
from trackgraph.llm import markup
from trackgraph.llm.groups import join_groups

#: A subtree belongs to a template from so many different pages of a host on, and from this share of them.
LEAST_PAGES, LEAST_SHARE = 5, 0.3
#: Digests of templates that are broadcast with their hosts at most; beyond it hosts with few pages meet their templates by a shuffle.
BROADCAST_DIGESTS = 1_000_000


def host(url: Column) -> Column:
    """The host in lower case; null without one."""
    name = F.regexp_extract(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.when(name != "", name)


def page_subtrees(pages: DataFrame) -> DataFrame:
    """``host, digest, identity`` of every subtree of every page that has a host, each once for a page.

    ``identity`` tells pages apart by the longest block of their text, so that copies of one article do not make its blocks a template.
    """
    schema = "host string, digest long, identity long"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hosts, digests, identities = [], [], []
            for name, html in zip(b.column("host").to_pylist(), b.column("html").to_pylist()):
                page = markup.read(html)
                markup.hashed(page)
                plan = markup.layout(page)
                found = markup.subtrees(page, plan)
                longest = max(markup.blocks(page, plan), key=len, default="")
                hosts += [name] * len(found)
                digests += found
                identities += [int.from_bytes(markup.blake2b(longest.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(digests, pa.int64()), pa.array(identities, pa.int64())], names=["host", "digest", "identity"])

    return pages.where("host is not null and html is not null").select("host", "html").mapInArrow(read, schema)


def templates(subtrees: DataFrame, hosts: DataFrame, total: int, least: int = LEAST_PAGES, share: float = LEAST_SHARE) -> DataFrame:
    """``host, template`` (array of digests) of subtrees on at least ``least`` different pages and ``share`` of a host's.

    ``hosts`` has ``host, group_rows``, the pages of each. A host has at most as many of them as its pages have subtrees on average,
    divided by ``share``.
    """
    with scratch(subtrees.sparkSession) as kept:
        counted = subtrees.groupBy("host", "digest").agg(F.count_distinct("identity").alias("pages"))
        often = kept(counted.where(F.col("pages") >= least), "subtrees")
    different = subtrees.groupBy("host").agg(F.count_distinct("identity").alias("different"))
    sizes = hosts.join(different, "host")
    marked = join_groups(often, sizes, ["host"], total)
    return marked.where(F.col("pages") >= share * F.col("different")).groupBy("host").agg(F.collect_list("digest").alias("template"))


@F.pandas_udf(StringType())
def _main_text(html: pd.Series, template: pd.Series) -> pd.Series:
    out = []
    for text, digests in zip(html, template):
        page = markup.read(text or "")
        known = frozenset(digests.tolist()) if digests is not None else frozenset()
        if known:
            markup.hashed(page)
        out.append("\n".join(markup.blocks(page, markup.layout(page), known)))
    return pd.Series(out, dtype=object)


def with_main_text(pages: DataFrame, url: str = "url", html: str = "html", text: str = "text") -> DataFrame:
    """``pages`` with ``text``, the article of each page: one line for each block, white space made one space, references decoded.

    The article is what the page's outermost ``article`` elements (else its ``main``, else its body) hold, without elements that are
    marked as something else and without the template of the page's host. Inside an article only containers, never its paragraphs,
    headings, items or cells, are taken for a template. A null or empty page has an empty text; a page without a host (null or odd
    url) has no template. Broken markup is mended: unclosed elements end where their parents do. Rows may repeat, extra columns stay,
    a column named like the result is replaced. An empty table gives no rows.
    """
    with scratch(pages.sparkSession) as kept:
        named = pages.withColumn("__host", host(F.col(url)))
        sites = named.select(F.col("__host").alias("host"), F.col(html).alias("html"))
        hosts = staged(sites.where("host is not null").groupBy("host").agg(F.count("*").alias("group_rows")), "hosts")
        total = hosts.agg(F.sum("group_rows")).first()[0] or 0
        found = kept(templates(staged(page_subtrees(sites), "subtrees"), hosts, total).join(hosts, "host"), "templates")
    columns = [c for c in pages.columns if c != text]
    keyed = found.withColumnRenamed("host", "__host").withColumnRenamed("template", "__template")
    digests = found.agg(F.sum(F.size("template"))).first()[0] or 0
    if digests <= BROADCAST_DIGESTS:
        met = named.join(F.broadcast(keyed.drop("group_rows")), "__host", "left")
    else:
        met = join_groups(named, keyed, ["__host"], total, how="left")
    return met.select(*columns, _main_text(F.col(html), F.col("__template")).alias(text))


def main_texts(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` (code points) of every page."""
    return with_main_text(pages.select("page_id", "url", "html")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
