"""A crawl as tables: a breadth-first frontier, what was seen, and the order in which pages were met."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..sources.pages import links
from ..tables import cut, discard
from .ranking import global_rank

SEEN = "url string, depth int, place long, parent string"


def absolute(base: Column, target: Column) -> Column:
    """A link's address without fragment; empty for what is no page (mail, scripts, anchors)."""

    @F.pandas_udf("string")
    def join(b: pd.Series, t: pd.Series) -> pd.Series:
        from urllib.parse import urldefrag, urljoin

        def one(x: str, y: str) -> str:
            try:
                u = urldefrag(urljoin(x, y.strip())).url
            except ValueError:
                return ""
            return u if u.startswith(("http://", "https://")) else ""

        return pd.Series([one(x, y) if x is not None and y is not None else "" for x, y in zip(b, t, strict=True)], dtype=object)

    whole = F.rlike(target, F.lit(r"^https?://[A-Za-z0-9.-]+/[A-Za-z0-9._~/%=&+,-]*(\?[A-Za-z0-9._~/%=&+,-]+)?$"))  # as most are
    return F.when(whole, target).otherwise(join(base, target))


def crawl(seeds: DataFrame, pages: Callable[[DataFrame], DataFrame], limit: int | None = None, depth: int | None = None, allowed: Callable[[Column], Column] | None = None) -> DataFrame:
    """(url, place) -> (url, depth, place, parent): the pages that a breadth-first crawl visits, numbered from 0 in its order.

    ``pages`` gives (url, html) of a table of urls: a join with stored pages, or ``sources.fetching.fetched`` over the network,
    which paces hosts. Each depth is one round: the frontier's pages are read, their links in the order of (parent's place,
    place in the page), each link kept where it is first met, and what was seen before is dropped by an anti-join. ``limit``
    stops after so many pages, as a crawl that goes one by one would; ``depth`` after so many rounds of links; ``allowed``
    keeps links that it likes. Seeds that are repeated count once; null or empty urls never.

    Tables grow with what was met; only each round's size comes to the driver. An unread page has no links. No seed: no row.
    """
    spark = seeds.sparkSession
    first = seeds.where("coalesce(url, '') <> ''").groupBy("url").agg(F.min("place").alias("at"))
    front = global_rank(first.withColumn("parent", F.lit(None).cast("string")), [F.col("at"), F.col("url")], "place").withColumn("place", F.col("place") - 1)
    front = cut(front.select("url", F.lit(0).alias("depth"), "place", "parent"), "front")
    done, count, level = [], 0, 0
    while (n := front.count()) > 0:
        if limit is not None and count + n >= limit:
            done.append(front.where(F.col("place") < limit))
            break
        done.append(front)
        count, level = count + n, level + 1
        if depth is not None and level > depth:
            break
        read = pages(front.select("url")).select("url", "html").join(front, "url")
        met = read.select(F.col("url").alias("parent"), "place", F.posexplode(links(F.col("html"))).alias("i", "target"))
        met = met.select("parent", absolute(F.col("parent"), F.col("target")).alias("url"), F.struct("place", "i").alias("at")).where("url <> ''")
        if allowed:
            met = met.where(allowed(F.col("url")))
        met = met.groupBy("url").agg(F.min(F.struct("at", "parent")).alias("m"))
        for seen in done:
            met = met.join(seen.select("url"), "url", "left_anti")
        new = cut(met.select("url", "m.at", "m.parent"), "met")
        ranked = global_rank(new, [F.col("at")], "place").select("url", F.lit(level).alias("depth"), (F.col("place") - 1 + count).alias("place"), "parent")
        front = cut(ranked, "front")
        discard(spark, new)
    out = spark.createDataFrame([], SEEN)
    for d in done:
        out = out.unionByName(d)
    return out
