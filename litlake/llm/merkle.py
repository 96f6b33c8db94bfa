"""Merkle manifest of a dataset: a sparse forest of unresolved nodes, merged associatively whenever a run of siblings is whole."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..operators.ranking import global_rank
from ..tables import cut, discard

#: Nodes that are hashed into one.
ARITY = 3
#: The number of the tree whose leaves are the other trees' roots.
TOP = -1
#: Rows of a fragment, and fragments that a merge takes at once: they bound a task's memory, not what is processed.
FRAGMENT, FAN = 8192, 64

Key = tuple[int, int, int]  # tree, level, index

NODE = T.StructType(
    [T.StructField("tree", T.LongType()), T.StructField("level", T.IntegerType()), T.StructField("index", T.LongType()), T.StructField("width", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("at", T.LongType())]
)
STEP = T.StructType(
    [T.StructField("tree", T.LongType()), T.StructField("level", T.IntegerType()), T.StructField("index", T.LongType()), T.StructField("path", T.BinaryType()), *(T.StructField(f"up_{f.name}", f.dataType) for f in NODE)]
)
ROWS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("leaf", T.BinaryType()), T.StructField("tampered", T.BinaryType()), T.StructField("levels", T.IntegerType()), T.StructField("path", T.BinaryType()), *(T.StructField(f"up_{f.name}", f.dataType) for f in NODE), T.StructField("first", T.BooleanType())]
)


def digest_of(parts: Iterable[bytes]) -> bytes:
    """SHA-256 of digests, concatenated as lowercase hex text."""
    return hashlib.sha256("".join(p.hex() for p in parts).encode()).digest()


def leaf_of(columns: Sequence[Column]) -> Column:
    """SHA-256 of values, each ``-`` if null, else its size in UTF-8 bytes, a colon and the value as text."""
    text = [c.cast("string") for c in columns]
    return F.unhex(F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text)), 256))


def height(width: int, arity: int = ARITY) -> int:
    """Levels above the leaves of a tree with ``width`` leaves."""
    n = 0
    while width > 1:
        width, n = -(-width // arity), n + 1
    return n


def _placed(tree: int, level: int, index: int, width: int, trees: int) -> tuple[Key, int]:
    """A tree's only node of a level is its root, and as such a leaf of the tree of roots."""
    return ((TOP, 0, tree), trees) if width == 1 and tree != TOP else ((tree, level, index), width)


class Forest:
    """Nodes that wait for siblings, by (tree, level, index). ``add`` then ``settle`` is the monoid's product: the nodes that are
    left don't depend on how the leaves were grouped before."""

    def __init__(self, trees: int, arity: int = ARITY):
        self.trees, self.arity = trees, arity
        self.nodes: dict[Key, tuple[int, bytes, int]] = {}
        self._up: dict[Key, tuple[Key, bytes]] = {}
        self._paths: dict[Key, tuple[bytes, Key]] = {}

    def add(self, tree: int, level: int, index: int, width: int, digest: bytes, at: int) -> Key:
        key, width = _placed(tree, level, index, width, self.trees)
        self.nodes[key] = (width, digest, at)
        return key

    def settle(self) -> None:
        """Hashes every whole run of siblings into its parent, and so on upwards."""
        fresh = list(self.nodes)
        while fresh:
            runs = {(t, lev, i // self.arity) for t, lev, i in fresh}
            fresh = []
            for t, lev, run in runs:
                keys = [(t, lev, i) for i in range(run * self.arity, (run + 1) * self.arity)]
                width = next((self.nodes[k][0] for k in keys if k in self.nodes), 1)  # a run may be resolved since
                keys = keys[: width - run * self.arity]
                if width == 1 or any(k not in self.nodes for k in keys):
                    continue
                rows = [self.nodes.pop(k) for k in keys]
                digests = [r[1] for r in rows]
                parent = self.add(t, lev + 1, run, -(-width // self.arity), digest_of(digests), min(r[2] for r in rows))
                for i, k in enumerate(keys):
                    others = digests[:i] + digests[i + 1 :]
                    self._up[k] = (parent, bytes([i, len(others)]) + b"".join(others))
                fresh.append(parent)

    def path(self, key: Key) -> tuple[bytes, Key]:
        """A node's steps up to the waiting node above it, and that node. A step: digests before it, digests, and these."""
        way = []
        while key not in self._paths and key in self._up:
            way.append(key)
            key = self._up[key][0]
        found = self._paths.get(key, (b"", key))
        for k in reversed(way):
            found = self._paths[k] = (self._up[k][1] + found[0], found[1])
        return found

    def waiting(self, key: Key) -> tuple[int, int, int, int, bytes, int]:
        return (*key, *self.nodes[key])


def steps(path: bytes) -> Iterator[tuple[int, list[bytes]]]:
    """(digests before the node, the siblings' digests) of each level."""
    at = 0
    while at < len(path):
        left, n = path[at], path[at + 1]
        at += 2
        yield left, [path[at + 32 * i : at + 32 * (i + 1)] for i in range(n)]
        at += 32 * n


def climbed(leaf: bytes, path: bytes, levels: int) -> tuple[bytes, bytes]:
    """(the digest after ``levels`` steps, after all) from a leaf along its path."""
    now = below = leaf
    for n, (left, others) in enumerate(steps(path), 1):
        now = digest_of([*others[:left], now, *others[left:]])
        if n == levels:
            below = now
    return below, now


def _fragments(rows: DataFrame, trees: int, arity: int, fragment: int) -> DataFrame:
    """Rows with their path inside their own fragment, and the node that waits above them there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, fragment):
                b = whole.slice(begin, fragment).to_pydict()
                forest = Forest(trees, arity)
                keys = [forest.add(t, 0, i, w, leaf, at) for t, i, w, leaf, at in zip(b["tree"], b["index"], b["width"], b["leaf"], b["at"], strict=True)]
                forest.settle()
                out, seen = [], set()
                for n, key in enumerate(keys):
                    path, up = forest.path(key)
                    out.append((b["doc_id"][n], b["leaf"][n], b["tampered"][n], height(b["width"][n], arity), path, *forest.waiting(up), up not in seen))
                    seen.add(up)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], [f.name for f in ROWS])

    types = [pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.bool_()]
    return rows.mapInArrow(run, ROWS)


def _merged(nodes: DataFrame, span: int, trees: int, arity: int) -> DataFrame:
    """Waiting nodes of ``span`` leaves each, merged: every node's path in this merge and the node that waits above it."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        forest = Forest(trees, arity)
        keys = [forest.add(*r) for r in zip(*(table[f.name].to_pylist() for f in NODE), strict=True)]
        forest.settle()
        out = [(*k, path, *forest.waiting(up)) for k, (path, up) in ((k, forest.path(k)) for k in keys)]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], [f.name for f in STEP])

    return nodes.groupBy(F.floor(F.col("at") / span)).applyInArrow(run, STEP)


def _key(prefix: str = "") -> list[Column]:
    return [F.col(f"{prefix}{n}").alias(n) for n in ("tree", "level", "index")]


def manifest(docs: DataFrame, columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), by: str = "source", tampered: Column | None = None, arity: int = ARITY, fragment: int = FRAGMENT, fan: int = FAN) -> DataFrame:
    """Every row's leaf and what proves it: doc_id, leaf, tampered (binary), levels (of its own tree), path, root (binary).

    The leaf is the digest of ``columns``; per ``by`` the leaves ascend by doc_id and form a tree of ``arity``, and the trees'
    roots, ordered by ``by`` (null first, bytewise), form the tree of the root. ``path`` holds the siblings' digests level by
    level (``steps`` reads it, ``climbed`` folds a leaf along it). ``tampered`` is carried along.

    Leaves are numbered by one range sort of digests; texts aren't shuffled. Fragments of ``fragment`` leaves resolve all runs
    that are whole inside them; the few nodes that wait at their edges (two an edge and level) are merged ``fan`` fragments at
    a time until the root is left: a tree reduction whose rounds are tables, as proofs need the nodes in between (an RDD's
    treeReduce would keep only the root) and so that nothing but one row comes to the driver. The rounds' paths are then
    joined from the last one down.

    Null columns count as ``-``; a null doc_id comes first. Rows of equal doc_id are ordered by leaf; equal rows are leaves of
    their own, and it makes no difference which is which. An empty table gives no row; other columns are ignored.
    """
    spark = docs.sparkSession
    values = [F.col(f"`{c}`") for c in columns]
    other = F.lit(None).cast("binary") if tampered is None else tampered
    leaves = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(by).cast("string").alias("by"), leaf_of(values).alias("leaf"), other.alias("tampered"), F.monotonically_increasing_id().alias("row")), "leaves")
    ranked = global_rank(leaves, [F.asc_nulls_first("by"), F.asc_nulls_first("doc_id"), F.col("leaf"), F.col("row")], "at")
    sizes = cut(ranked.groupBy("by").agg(F.count("*").alias("width"), F.min("at").alias("begin")), "trees")
    trees = sizes.count()
    numbered = cut(global_rank(sizes, [F.col("begin")], "tree").withColumn("tree", F.col("tree") - 1), "trees")
    rows = ranked.alias("r").join(numbered.alias("n"), F.col("r.by").eqNullSafe(F.col("n.by")))
    rows = rows.select("doc_id", "leaf", "tampered", "tree", (F.col("at") - F.col("begin")).alias("index"), "width", (F.col("at") - 1).alias("at"))
    rows = cut(_fragments(rows, trees, arity, fragment), "fragments")

    n, span, rounds = sizes.agg(F.sum("width")).first()[0] or 0, fragment, []
    nodes = rows.where("first").select(*(F.col(f"up_{f.name}").alias(f.name) for f in NODE))
    while span < n or not rounds:
        span *= fan
        rounds.append(cut(_merged(nodes, span, trees, arity), "merged"))
        nodes = rounds[-1].select(*(F.col(f"up_{f.name}").alias(f.name) for f in NODE)).distinct()

    root = nodes.where(F.col("tree") == TOP).select(F.col("digest").alias("root"))
    above: DataFrame = rounds[-1].select(*_key(), "path")

    def down(upper: DataFrame, lower: DataFrame) -> DataFrame:
        up = upper.select(*(F.col(c).alias(f"up_{c}") for c in ("tree", "level", "index")), F.col("path").alias("rest"))
        return lower.join(up, ["up_tree", "up_level", "up_index"]).select(*_key(), F.concat("path", "rest").alias("path"))

    above = cut(reduce(down, reversed(rounds[:-1]), above), "paths")
    discard(spark, *rounds[:-1], sizes)
    up = above.select(*(F.col(c).alias(f"up_{c}") for c in ("tree", "level", "index")), F.col("path").alias("rest"))
    out = rows.join(up, ["up_tree", "up_level", "up_index"]).select("doc_id", "leaf", "tampered", "levels", F.concat("path", "rest").alias("path"))
    return out.join(F.broadcast(root), F.lit(True))  # one row


VERIFIED = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def verified(rows: DataFrame) -> DataFrame:
    """``manifest``'s rows with their tree's root, the digest of their siblings, the root that the tampered, else the original,
    leaf leads to, and whether it is the manifest's root. Digests are lowercase hex."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = b.to_pydict()
            out = []
            for doc, leaf, other, levels, path, root in zip(*(d[c] for c in ("doc_id", "leaf", "tampered", "levels", "path", "root")), strict=True):
                subroot, top = climbed(leaf, path, levels)
                folded = top if other is None else climbed(other, path, levels)[1]
                out.append((doc, leaf.hex(), subroot.hex(), root.hex(), digest_of(x for _, xs in steps(path) for x in xs).hex(), folded.hex(), folded == root))
            if out:
                types = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], [f.split()[0] for f in VERIFIED.split(", ")])

    return rows.mapInArrow(run, VERIFIED)


def audit(docs: DataFrame) -> DataFrame:
    """The manifest of documents, checked against copies whose texts have lost their line feeds where 2 divides the id's CRC-32."""
    text = F.col("text").cast("string")
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    bare = leaf_of([F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), F.replace(text, F.lit("\n"), F.lit(""))])
    return verified(manifest(docs, tampered=F.when(changed & F.contains(text, F.lit("\n")), bare)))


def duckdb_sql() -> str:
    """The same in DuckDB: levels by a recursive query, each leaf's siblings by joins, the fold level by level."""
    field = lambda c: f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-')"
    row = lambda t: "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", t)) + ")"
    bit = "list_reduce(list_prepend(xor(s, b), [x::ubigint for x in range(8)]), lambda a, i: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384::ubigint) ELSE a >> 1 END)"
    crc = f"xor(4294967295::ubigint, list_reduce(list_prepend(4294967295::ubigint, [ascii(c)::ubigint for c in string_split(doc_id::varchar, '')]), lambda s, b: {bit}))"
    tree = lambda name, start: f"""{name} AS (
  {start}
  UNION ALL
  SELECT src, level + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx)), (any_value(width) + 2) // 3
  FROM {name} WHERE width > 1 GROUP BY src, level, idx // 3)"""  # noqa: E731
    return f"""WITH RECURSIVE docs AS (
  SELECT *, row_number() OVER () AS n, {row('text')} AS leaf, {row("replace(text, chr(10), '')")} AS bare, doc_id IS NOT NULL AND {crc} % 2 = 0 AS odd FROM documents),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, n) - 1 AS idx, count(*) OVER (PARTITION BY source) AS width,
    dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS src FROM docs),
{tree('low', 'SELECT src::bigint AS src, 0::bigint AS level, idx::bigint AS idx, leaf AS h, width::bigint AS width FROM placed')},
subs AS (SELECT src, level AS levels, h AS subroot FROM low WHERE width = 1),
{tree('high', 'SELECT -1::bigint AS src, 0::bigint AS level, src::bigint AS idx, subroot AS h, (count(*) OVER ())::bigint AS width FROM subs')},
nodes AS (SELECT l.src, level, idx, h, width FROM low l UNION ALL SELECT * FROM high),
at_level AS (
  SELECT n, src, idx::bigint AS idx, 0::bigint AS level, width::bigint AS width, 0::bigint AS step, src::bigint AS home FROM placed
  UNION ALL
  SELECT n, CASE WHEN width > 1 THEN src ELSE -1 END, CASE WHEN width > 1 THEN idx // 3 ELSE home END, CASE WHEN width > 1 THEN level + 1 ELSE 0 END,
    CASE WHEN width > 1 THEN (width + 2) // 3 ELSE (SELECT count(*) FROM subs) END, CASE WHEN width > 1 THEN step + 1 ELSE step END, home
  FROM at_level WHERE width > 1 OR src >= 0),
sides AS (
  SELECT a.n, a.step, coalesce(string_agg(o.h, '' ORDER BY o.idx) FILTER (WHERE o.idx < a.idx), '') AS l, coalesce(string_agg(o.h, '' ORDER BY o.idx) FILTER (WHERE o.idx > a.idx), '') AS r
  FROM at_level a JOIN nodes o ON o.src = a.src AND o.level = a.level AND o.idx // 3 = a.idx // 3 WHERE a.width > 1 GROUP BY a.n, a.step, a.idx),
folds AS (
  SELECT n, 0::bigint AS step, CASE WHEN odd AND text IS NOT NULL THEN bare ELSE leaf END AS h FROM docs
  UNION ALL
  SELECT f.n, f.step + 1, sha256(s.l || f.h || s.r) FROM folds f JOIN sides s USING (n, step)),
ends AS (SELECT n, max_by(h, step) AS folded_root FROM folds GROUP BY n),
proofs AS (SELECT n, sha256(string_agg(l || r, '' ORDER BY step)) AS proof_sha256 FROM sides GROUP BY n)
SELECT doc_id, leaf, subroot, h AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = h AS verified
FROM placed JOIN subs USING (src) JOIN ends USING (n) LEFT JOIN proofs USING (n) CROSS JOIN (SELECT h FROM high WHERE width = 1)"""
