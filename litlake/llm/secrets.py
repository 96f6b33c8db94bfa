"""Secrets by pattern, judged by how widely each value is copied over repositories and owners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ._shared import cut

#: Kind, pattern, the group that holds the secret, what a text must contain to be searched, the least length
#: of that group. The first three are the base kinds, in their order; the rest the method adds where the value looks live.
KINDS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, "(?i:passw|secret|token|api_?key)", 6),
    ("access", r"AKIA[A-Z0-9]+", 0, "AKIA", 20),
    # [0-9a-f]+ of 24 or more: a run that is shorter is never part of a longer one
    ("hex", r"[0-9a-f]{24,}", 0, None, 24),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, "eyJ", 24),
    ("prefixed", r"(?:ghp_|gho_|github_pat_|sk_live_|rk_live_|xox[abprs]-|glpat-|npm_)[A-Za-z0-9_-]+", 0, "ghp_|gho_|github_pat_|sk_live_|rk_live_|xox[abprs]-|glpat-|npm_", 20),
)
BASE = 3
#: A value of more owners than this is a copied example; so is one that its owners have in more repositories each than this.
MOST_OWNERS, MOST_REPOSITORIES = 2, 12
#: What stands in examples where a secret would be, and characters of different kinds that a secret has at least.
PLACEHOLDER = "change.?me|passw|secret|example|sample|dummy|placeholder|your[_.-]|insert|redacted|foobar|qwerty|^test|1234567|x{4}|^none$|^null$|^true|^false"
LEAST_DIFFERENT = 5


def _found(text: Column, kind: int) -> Column:
    """The kind's matches in order as (kind, place, gap, size, value): ``gap`` characters lie between a match and the one before."""
    _, pattern, group, need, _ = KINDS[kind]
    whole, value = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    rows = F.transform(
        F.arrays_zip(whole.alias("m"), value.alias("v"), F.slice(F.split(text, pattern, -1), 1, F.size(whole)).alias("g")),
        lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("place"), F.length(x["g"]).alias("gap"), F.length(x["m"]).alias("size"), x["v"].alias("value")),
    )
    return F.when(text.rlike(need or pattern), rows)


def live_looking(value: Column) -> Column:
    """No placeholder, and not a few characters again and again."""
    return ~F.rlike(F.lower(value), F.lit(PLACEHOLDER)) & (F.size(F.array_distinct(F.regexp_extract_all(value, F.lit("(?s)."), F.lit(0)))) >= LEAST_DIFFERENT)


def find_secrets(docs: DataFrame, most_owners: int = MOST_OWNERS, most_repositories: int = MOST_REPOSITORIES) -> DataFrame:
    """Every row's secrets: doc_id and ``found``, an array of (start, kind_no, end, kind, value_hash, repositories, owners, live).

    A value's SHA-256 is counted over the whole table by distinct documents (repositories) and sources (owners). It is a copied
    example if more than ``most_owners`` owners have it, or if its owners have it in more than ``most_repositories`` documents
    each on average, or if it reads like a placeholder (``live_looking``); else it is ``live``: a few owners' own. ``found``
    holds all base spans and of the added kinds the live ones, by start, then kind. Positions are code points, end exclusive.

    Null or empty text: an empty array. A null source is the same owner as an empty one. Repeated rows are answered each; a doc_id
    counts once for a value and owner. Texts are searched whole; other columns are ignored; an empty table gives no row.
    Nothing but counted hashes is shuffled by value, first within document, then owner, so a value that a third of all rows
    hold is summed before it meets; the join back to its rows is one that adaptive execution splits.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    arrays = [F.coalesce(_found(text, k), F.array().cast("array<struct<kind:int,place:int,gap:int,size:int,value:string>>")) for k in range(len(KINDS))]
    raw = cut(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("owner"), F.concat(*arrays).alias("c")), "secrets")
    seen = raw.where(F.size("c") > 0).select("row", "doc_id", "owner", F.inline("c"))
    w = Window.partitionBy("row", "kind").orderBy("place")
    end = F.sum(F.col("gap") + F.col("size")).over(w)
    least = F.element_at(F.array(*[F.lit(k[4]) for k in KINDS]), F.col("kind") + 1)
    seen = seen.withColumn("end", end.cast("long")).where(F.length("value") >= least)
    seen = seen.select("row", "doc_id", "owner", "kind", (F.col("end") - F.col("size")).alias("start"), "end", F.sha2("value", 256).alias("value_hash"), live_looking(F.col("value")).alias("looks"))
    owned = seen.groupBy("value_hash", "owner", "doc_id").agg(F.lit(1)).groupBy("value_hash", "owner").agg(F.count("*").alias("r"))
    owned = owned.groupBy("value_hash").agg(F.sum("r").alias("repositories"), F.count("*").alias("owners"))
    names = F.array(*[F.lit(k[0]) for k in KINDS])
    few = (F.col("owners") <= most_owners) & (F.col("repositories") <= most_repositories * F.col("owners"))
    judged = seen.join(owned, "value_hash").withColumn("live", few & F.col("looks")).where((F.col("kind") < BASE) | F.col("live"))
    entry = F.struct("start", F.col("kind").alias("kind_no"), "end", F.element_at(names, F.col("kind") + 1).alias("kind"), "value_hash", "repositories", "owners", "live")
    by_row = judged.groupBy("row").agg(F.sort_array(F.collect_list(entry)).alias("found"))
    kind = by_row.schema["found"].dataType
    return raw.select("row", "doc_id").join(by_row, "row", "left").select("doc_id", F.coalesce("found", F.array().cast(kind)).alias("found"))


def digest(found: DataFrame) -> DataFrame:
    """What the query returns of ``find_secrets``."""
    count = lambda k: F.size(F.filter("found", lambda x: x["kind_no"] == k)).cast("long")
    spans = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{KINDS[k][0]}") for k in range(BASE)],
        F.sha2(spans(F.filter("found", lambda x: x["kind_no"] < BASE)), 256).alias("base_sha256"),
        spans(F.col("found")).alias("spans"),
        F.size(F.filter("found", lambda x: x["live"])).cast("long").alias("n_live"),
        F.size(F.filter("found", lambda x: ~x["live"])).cast("long").alias("n_example"),
    )


def duckdb_sql(most_owners: int = MOST_OWNERS, most_repositories: int = MOST_REPOSITORIES) -> str:
    """The same in DuckDB, whose patterns fold more than A-Z: letters of either case are written out."""
    import re

    either = lambda p: re.sub(r"\(\?i:([^)]*)\)", lambda m: "(?:" + re.sub("[a-z]", lambda c: f"[{c[0].upper()}{c[0]}]", m[1]) + ")", p)
    quoted = lambda p: "'" + either(p).replace("'", "''") + "'"
    kinds = " UNION ALL ".join(
        f"SELECT row, doc_id, owner, {k} AS kind, unnest(range(1, len(m) + 1)) AS place, unnest(m) AS m, unnest(v) AS value, unnest(g[1:len(m)]) AS gap FROM (SELECT row, doc_id, owner, regexp_extract_all(t, {quoted(p)}) AS m, regexp_extract_all(t, {quoted(p)}, {group}) AS v, string_split_regex(t, {quoted(p)}) AS g FROM d)"
        for k, (_, p, group, _, _) in enumerate(KINDS)
    )
    least = "[" + ", ".join(str(k[4]) for k in KINDS) + "]"
    names = "[" + ", ".join(f"'{k[0]}'" for k in KINDS) + "]"
    told = f"{names}[kind + 1] || ':' || start || ':' || stop"
    counts = ", ".join(f"count(*) FILTER (kind = {k})::BIGINT AS n_{KINDS[k][0]}" for k in range(BASE))
    return f"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(source, '') AS owner, coalesce(text, '') AS t FROM documents),
hits AS ({kinds}),
spans AS (SELECT *, sum(length(gap) + length(m)) OVER (PARTITION BY row, kind ORDER BY place)::BIGINT AS stop FROM hits),
seen AS (SELECT row, doc_id, owner, kind, stop - length(m) AS start, stop, value FROM spans WHERE length(value) >= {least}[kind + 1]),
owned AS (SELECT value, count(*) AS repositories, count(DISTINCT owner) AS owners FROM (SELECT DISTINCT value, owner, doc_id FROM seen) GROUP BY value),
judged AS (SELECT seen.*, owners <= {most_owners} AND repositories <= {most_repositories} * owners AND NOT regexp_matches(lower(value), '{PLACEHOLDER}') AND len(list_distinct(string_split(value, ''))) >= {LEAST_DIFFERENT} AS live FROM seen JOIN owned USING (value)),
told AS (SELECT row, {counts}, sha256(coalesce(string_agg({told}, ',' ORDER BY start, kind) FILTER (kind < {BASE}), '')) AS base_sha256, string_agg({told}, ',' ORDER BY start, kind) AS spans, count(*) FILTER (live)::BIGINT AS n_live, count(*) FILTER (NOT live)::BIGINT AS n_example
  FROM judged WHERE kind < {BASE} OR live GROUP BY row)
SELECT doc_id, {", ".join(f"coalesce(n_{KINDS[k][0]}, 0) AS n_{KINDS[k][0]}" for k in range(BASE))}, coalesce(base_sha256, sha256('')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example FROM d LEFT JOIN told USING (row)"""
