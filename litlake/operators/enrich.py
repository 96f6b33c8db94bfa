"""Records of one paper from several sources, merged in order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Of equal citation counts the source with the higher number wins.
PRIORITY = {"semantic-scholar": 4, "openalex": 3, "europe-pmc": 2, "crossref": 1}


def best_citation(counts: Column) -> Column:
    """map<source, count> -> struct(count, priority, source) of the largest count, ties by priority; null if empty."""
    rank = F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])
    entries = F.transform(F.map_entries(counts), lambda e: F.struct(e["value"].alias("count"), F.coalesce(F.element_at(rank, e["key"]), F.lit(0)).alias("priority"), e["key"].alias("source")))
    return F.array_max(entries)


def merge_sources(articles: DataFrame, sources: Sequence[tuple[str, DataFrame]], key: str = "doi") -> DataFrame:
    """Each source, in order, fills what is still empty: texts, then authors and institutions as whole lists, the abstract
    with its source's name; citation counts of all sources are kept and the largest wins. Sources have one row for a key.

    Every step is a left outer join on the same key, so one partitioning serves them all."""
    out = articles.withColumn("citation_counts", F.coalesce("citation_counts", F.create_map().cast("map<string,int>")))
    text, lists = ["title", "journal", "article_type", "publish_date"], ["authors", "institutions"]
    for name, source in sources:
        s = source.select(F.col(key).alias(key), *[F.col(c).alias(f"_{c}") for c in (*text, *lists, "abstract", "citation_count")])
        out = out.join(s, key, "left")
        fill = {c: F.when(F.coalesce(c, F.lit("")) == "", F.coalesce(f"_{c}", F.lit(""))).otherwise(F.col(c)) for c in text}
        fill |= {c: F.when((F.size(c) <= 0) & (F.size(f"_{c}") > 0), F.col(f"_{c}")).otherwise(F.col(c)) for c in lists}
        takes = (F.coalesce("abstract", F.lit("")) == "") & (F.coalesce("_abstract", F.lit("")) != "")
        fill |= {"abstract_source": F.when(takes, name).otherwise(F.col("abstract_source")), "abstract": F.when(takes, F.col("_abstract")).otherwise(F.col("abstract"))}
        fill["citation_counts"] = F.when(F.col("_citation_count").isNotNull(), F.map_concat(F.map_filter("citation_counts", lambda k, _: k != name), F.create_map(F.lit(name), F.col("_citation_count")))).otherwise(F.col("citation_counts"))
        fill["metadata_sources"] = F.when(F.col("_title").isNotNull(), F.array_distinct(F.array_append("metadata_sources", F.lit(name)))).otherwise(F.col("metadata_sources"))
        out = out.withColumns(fill).drop(*[f"_{c}" for c in (*text, *lists, "abstract", "citation_count")])
    best = best_citation(F.col("citation_counts"))
    return out.withColumns({"citation_count": F.coalesce(best["count"], F.col("citation_count")), "citation_source": F.coalesce(best["source"], F.col("citation_source"))})


def first_wins(layers: Sequence[DataFrame], key: Column, limit: int | None = None) -> DataFrame:
    """The union of layers in order, of each key the first layer's first row; then the first ``limit`` rows."""
    union = None
    for i, layer in enumerate(layers):
        part = layer.withColumn("_layer", F.lit(i))
        union = part if union is None else union.unionByName(part, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("_layer", "_ord")
    out = union.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return out if limit is None else out.orderBy("_layer", "_ord").limit(limit)


def merge_topics(rows: DataFrame) -> DataFrame:
    """(id, pos, source, taxonomy, label, ...) -> one row for each id and case-folded (source, taxonomy, label), the first."""
    w = Window.partitionBy("id", F.lower("source"), F.lower("taxonomy"), F.lower("label")).orderBy("pos")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
