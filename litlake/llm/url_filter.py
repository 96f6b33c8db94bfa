"""URL filter: host and path rules first, then a tree of path templates judged by smoothed labelled purity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ._shared import cut

#: (verdict, rule): a host, which covers its subdomains, and how a path begins.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Levels of the tree at most; what lies deeper is one last segment.
LEVELS = 16
#: A node with this many children, of which each holds less than two URLs on average, has a variable segment below it.
FAN_OUT = 16
#: Labelled URLs that a branch needs before it is compared with its siblings, and the z below which it is like them.
SUPPORT, Z = 5, 1.96
#: How many labelled URLs the purity that a template is smoothed towards counts for.
WEIGHT = 4.0


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or end, ASCII lower-cased; path: then up to ``?`` or ``#``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(F.coalesce(rest, F.lit("")), "^[^/?#]*", 0)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(F.coalesce(rest, F.lit("")), "^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits (of equally long ones a blocking one) and its verdict; null without any."""
    rule = verdict = F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[0] == "block")):
        name, _, start = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + start))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def shapes(path: Column, levels: int = LEVELS) -> Column:
    """The path's segments; those past ``levels`` are one."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.when(F.size(parts) > levels, F.concat(F.slice(parts, 1, levels - 1), F.array(F.array_join(F.slice(parts, levels, 1 << 30), "/")))).otherwise(parts)


def template_tree(counts: DataFrame, levels: int) -> DataFrame:
    """(host, shape, n, labelled, blocked) -> the same with ``base`` and ``template``.

    Level by level, each node's children are counted, in its host and in all hosts together; where they are many and nearly
    unique in either, the segment is variable and becomes ``*``. In ``template`` also those labelled children whose share of
    blocked URLs can't be told from that of their siblings merge into ``+``; others keep their name. Nodes are summed by key
    before they meet, and no group is ever gathered.
    """
    tree = counts.withColumns({"base": F.lit(""), "template": F.lit("")})
    node_key = ["host", "base", "template"]
    for level in range(levels):
        seg = F.get("shape", F.lit(level))
        child = tree.where(seg.isNotNull()).groupBy(*node_key, seg.alias("seg")).agg(F.sum("n").alias("n"), F.sum("labelled").alias("l"), F.sum("blocked").alias("b"))
        node = child.groupBy(*node_key).agg(F.count("*").alias("children"), F.sum("n").alias("all_n"), F.sum("l").alias("all_l"), F.sum("b").alias("all_b"))
        pool = child.groupBy("base", "seg").agg(F.sum("n").alias("n")).groupBy("base").agg(F.count("*").alias("pool_children"), F.sum("n").alias("pool_n"))
        p, rest = F.col("all_b") / F.col("all_l"), F.col("all_l") - F.col("l")
        far = F.abs(F.col("b") / F.col("l") - (F.col("all_b") - F.col("b")) / rest)
        like = (F.col("l") >= SUPPORT) & (rest >= SUPPORT) & (far <= Z * F.sqrt(p * (1 - p) * (1 / F.col("l") + 1 / rest)))
        wide = ((F.col("children") >= FAN_OUT) & (F.col("all_n") < 2 * F.col("children"))) | ((F.col("pool_children") >= FAN_OUT) & (F.col("pool_n") < 2 * F.col("pool_children")))
        named = child.join(node, node_key).join(pool, "base").select(*node_key, "seg", F.when(wide, "*").otherwise(F.col("seg")).alias("plain"), F.when(wide, "*").when(like, "+").otherwise(F.col("seg")).alias("name"))
        tree = tree.withColumn("seg", seg).join(named, [*node_key, "seg"], "left")
        longer = lambda c, part: F.when(F.col(part).isNull(), F.col(c)).otherwise(F.concat(c, F.lit("/"), part))
        tree = cut(tree.withColumns({"base": longer("base", "plain"), "template": longer("template", "name")}).drop("seg", "plain", "name"), "tree")  # the next level reads it twice
    return tree


def purities(tree: DataFrame) -> DataFrame:
    """(host, template, purity): the share of blocked URLs among the labelled ones of a template, smoothed towards that of the
    like template of all hosts, which is smoothed towards its parent's, and so on up to the root, which starts from a half. So a
    host without labels is judged by what its templates, or how they begin, are elsewhere; without any label it's a half."""
    like = tree.groupBy("base").agg(F.sum("blocked").alias("b"), F.sum("labelled").alias("l"))
    parts = F.split("base", "/", -1)
    paths = like.select("base", "b", "l", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("i", "prefix"))
    sums = paths.groupBy("prefix").agg(F.sum("b").alias("b"), F.sum("l").alias("l"))
    steps = paths.select("base", "i", "prefix").join(sums, "prefix").groupBy("base").agg(F.array_sort(F.collect_list(F.struct("i", "b", "l"))).alias("steps"))  # as many as levels
    shared = steps.select("base", F.aggregate("steps", F.lit(0.5), lambda p, x: (x["b"] + WEIGHT * p) / (x["l"] + WEIGHT)).alias("shared"))
    rows = tree.groupBy("host", "template", "base").agg(F.sum("n").alias("n"), F.sum("blocked").alias("b"), F.sum("labelled").alias("l")).join(shared, "base")
    rows = rows.groupBy("host", "template").agg(F.sum("b").alias("b"), F.sum("l").alias("l"), (F.sum(F.col("n") * F.col("shared")) / F.sum("n")).alias("shared"))
    return rows.select("host", "template", F.round((F.col("b") + WEIGHT * F.col("shared")) / (F.col("l") + WEIGHT), 9).alias("purity"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, most: int = LEVELS) -> DataFrame:
    """Every page's verdict: that of its rule, else "block" if its template's smoothed purity of blocked URLs, among URLs that a
    rule labels, is over a half, else "allow".

    Columns: page_id, host, path, rule, verdict, template, purity (null where a rule fits). One row per row; repeated rows
    and ids stay. A url that is null, empty or without ``://`` has empty host and path, and is a template of its own unless a
    rule for the empty host exists. Other columns of ``pages`` are ignored; an empty table gives no row. Paths of over ``most``
    segments are compared by their first segments and the rest as one.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("given"), shapes(F.col("path"), most).alias("shape"))
    counts = rows.groupBy("host", "shape").agg(
        F.count("*").alias("n"), F.count("given").alias("labelled"), F.sum((F.coalesce("given", F.lit("")) == "block").cast("long")).alias("blocked")
    )
    counts = cut(counts, "shapes")
    depth = counts.agg(F.coalesce(F.max(F.size("shape")), F.lit(0))).first()[0]
    tree = template_tree(counts, depth)
    known = tree.select("host", "shape", "template").join(purities(tree), ["host", "template"])
    out = rows.join(known, ["host", "shape"], "left")
    own = F.when(F.col("purity") > 0.5, "block").otherwise("allow")
    free = F.col("given").isNull()
    return out.select("page_id", "host", "path", "rule", F.coalesce("given", own).alias("verdict"), F.when(free, F.col("template")).alias("template"), F.when(free, F.col("purity")).alias("purity"))


def duckdb_sql(levels: int = 6) -> str:
    """DuckDB's SQL for ``judge`` with RULES over the table pages, whose paths have up to ``levels`` segments."""
    rules = sorted(RULES, key=lambda r: (-len(r[1]), r[0] != "block"))
    fits = [(f"((host = '{t.partition('/')[0]}' OR ends_with(host, '.{t.partition('/')[0]}')) AND starts_with(path, '/{t.partition('/')[2]}'))", t, k) for k, t in rules]
    rule = "CASE " + " ".join(f"WHEN {c} THEN '{t}'" for c, t, _ in fits) + " END"
    given = "CASE " + " ".join(f"WHEN {c} THEN '{k}'" for c, _, k in fits) + " END"
    sql = f"""WITH cutoff AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    split_up AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*', 0), '{UPPER}', '{LOWER}') AS host,
        regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM cutoff),
    formed AS (SELECT *, {rule} AS rule, {given} AS given, list_filter(string_split(path, '/'), lambda s: s <> '') AS shape FROM split_up),
    t0 AS (SELECT host, shape, count(*) AS n, count(given) AS labelled, count(*) FILTER (WHERE given = 'block') AS blocked, '' AS base, '' AS template FROM formed GROUP BY host, shape)"""
    for i in range(levels):
        sql += f""",
    c{i} AS (SELECT host, base, template, shape[{i + 1}] AS seg, sum(n) AS n, sum(labelled) AS l, sum(blocked) AS b FROM t{i} WHERE len(shape) > {i} GROUP BY ALL),
    q{i} AS (SELECT base, count(DISTINCT seg) AS pool_children, sum(n) AS pool_n FROM c{i} GROUP BY 1),
    n{i} AS (SELECT *, count(*) OVER w AS children, sum(n) OVER w AS all_n, sum(l) OVER w AS all_l, sum(b) OVER w AS all_b FROM c{i} JOIN q{i} USING (base) WINDOW w AS (PARTITION BY host, base, template)),
    w{i} AS (SELECT *, (children >= {FAN_OUT} AND all_n < 2 * children) OR (pool_children >= {FAN_OUT} AND pool_n < 2 * pool_children) AS wide FROM n{i}),
    m{i} AS (SELECT host, base, template, seg, CASE WHEN wide THEN '*' ELSE seg END AS plain, CASE WHEN wide THEN '*'
        WHEN l >= {SUPPORT} AND all_l - l >= {SUPPORT} AND abs(b / l - (all_b - b) / (all_l - l)) <= {Z} * sqrt((all_b / all_l) * (1 - all_b / all_l) * (1 / l + 1 / (all_l - l))) THEN '+' ELSE seg END AS name FROM w{i}),
    t{i + 1} AS (SELECT t.host, t.shape, t.n, t.labelled, t.blocked, CASE WHEN m.plain IS NULL THEN t.base ELSE t.base || '/' || m.plain END AS base, CASE WHEN m.name IS NULL THEN t.template ELSE t.template || '/' || m.name END AS template
        FROM t{i} t LEFT JOIN m{i} m ON t.host = m.host AND t.base = m.base AND t.template = m.template AND len(t.shape) > {i} AND t.shape[{i + 1}] = m.seg)"""
    w = f"{WEIGHT}::DOUBLE"
    return sql + f""",
    likes AS (SELECT base, string_split(base, '/') AS parts, sum(blocked) AS b, sum(labelled) AS l FROM t{levels} GROUP BY 1),
    paths AS (SELECT base, i, array_to_string(parts[1:i], '/') AS prefix, b, l FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM likes)),
    sums AS (SELECT prefix, sum(b) AS b, sum(l) AS l FROM paths GROUP BY 1),
    steps AS (SELECT base, s.b / (s.l + {w}) AS part, ln({w} / (s.l + {w})) AS f, coalesce(sum(ln({w} / (s.l + {w}))) OVER (PARTITION BY base ORDER BY i DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above
        FROM paths JOIN sums s USING (prefix)),
    shared AS (SELECT base, sum(part * exp(above)) + 0.5 * exp(sum(f)) AS shared FROM steps GROUP BY 1),
    pure AS (SELECT host, template, round((sum(blocked) + {w} * (sum(n * shared) / sum(n))) / (sum(labelled) + {w}), 9) AS purity FROM t{levels} JOIN shared USING (base) GROUP BY ALL)
    SELECT f.page_id, f.host, f.path, f.rule, coalesce(f.given, CASE WHEN p.purity > 0.5 THEN 'block' ELSE 'allow' END) AS verdict,
        CASE WHEN f.given IS NULL THEN t.template END AS template, CASE WHEN f.given IS NULL THEN p.purity END::DOUBLE AS purity
    FROM formed f LEFT JOIN t{levels} t ON f.host = t.host AND f.shape = t.shape LEFT JOIN pure p ON p.host = t.host AND p.template = t.template"""
