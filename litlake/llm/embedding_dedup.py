"""Near-duplicate embeddings: exact pairs over a cosine threshold by dual traversal of cover trees."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._shared import components, cut
from ._vectors import blocks, usable

COSINE = 0.93
#: Vectors of a block, which has a cover tree of its own; points of a leaf.
BLOCK, LEAF = 2048, 48
#: Vectors beyond which a node is divided further; the few blocks of a smaller one all meet.
NODE = 8 * BLOCK
#: Vectors (about) from which the children of such a node are chosen, and how many it gets at most; every
#: vector goes to the nearest, and none depends on the choice for being found.
SAMPLE, FAN = 512, 32
#: Levels above the blocks at most; what is larger then is dealt into blocks by a hash.
LEVELS = 16
_SLACK = 1e-7


@dataclass
class Node:
    """A ball that covers its points: the centre is one of them, ``radius`` the largest distance to it."""

    points: np.ndarray
    centre: np.ndarray
    radius: float
    children: list[Node] = field(default_factory=list)


def cover_tree(x: np.ndarray, points: np.ndarray | None = None, head: int | None = None) -> Node:
    """Cover tree over the unit vectors ``x``. A node's children are a net at half its radius: each point lies in the ball of
    the first child within reach, and the parent's centre is the first child's as well. Where the net doesn't thin the
    points out, or few are left, the node is a leaf."""
    points = np.arange(len(x)) if points is None else points
    centre = x[points[0] if head is None else head]
    far = np.sqrt(((x[points] - centre) ** 2).sum(axis=1))
    node = Node(points, centre, float(far.max(initial=0.0)))
    if len(points) <= LEAF or node.radius < 1e-6:
        return node
    left, nets = points[np.argsort(far, kind="stable")], []
    while len(left):
        near = ((x[left] - x[left[0]]) ** 2).sum(axis=1) <= (node.radius / 2) ** 2
        nets.append(left[near])
        left = left[~near]
        if len(nets) > len(points) // 8:
            return node
    node.children = [cover_tree(x, p) for p in nets]
    return node


def linked(one: Node, two: Node, reach: float) -> Iterator[tuple[Node, Node]]:
    """Pairs of leaves that may hold points within ``reach``: a pair of nodes is left out if the distance of their centres is
    more than both covering radii and the reach. Of a tree and itself each pair comes once."""
    todo = [(one, two)]
    while todo:
        a, b = todo.pop()
        if a is not b and np.sqrt(((a.centre - b.centre) ** 2).sum()) > a.radius + b.radius + reach:
            continue
        if not a.children and not b.children:
            yield a, b
        elif a is b:
            todo += [(a.children[i], a.children[j]) for i in range(len(a.children)) for j in range(i, len(a.children))]
        elif not b.children or a.children and a.radius >= b.radius:
            todo += [(c, b) for c in a.children]
        else:
            todo += [(a, c) for c in b.children]


def _roots(hit: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids that rows and columns of a link matrix reach within it, each component's smallest."""
    top = np.iinfo(np.int64).max
    while True:
        new_b = np.minimum(b, np.where(hit, a[:, None], top).min(axis=0, initial=top))
        new_a = np.minimum(a, np.where(hit, new_b[None, :], top).min(axis=1, initial=top))
        if (new_a == a).all() and (new_b == b).all():
            return a, b
        a, b = new_a, new_b


def join_blocks(x: np.ndarray, ids: np.ndarray, times: np.ndarray, y: np.ndarray | None, ids_y: np.ndarray, times_y: np.ndarray, trees: tuple[Node, Node], cosine: float) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Links of each of x (and y) with vectors of the other block, copies counted, and edges that join what is linked.
    ``y`` None: of x with itself. Rows are vectors with their length; trees are of their unit vectors."""
    own = y is None
    y = x if own else y
    norm_x, norm_y = np.sqrt((x**2).sum(axis=1)), np.sqrt((y**2).sum(axis=1))
    n, m = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
    edges: list[tuple[int, int]] = []
    reach = float(np.sqrt(max(0.0, 2 - 2 * cosine))) + _SLACK
    for a, b in linked(*trees, reach):
        p, q = a.points, b.points
        sim = (x[p] @ y[q].T) / (norm_x[p][:, None] * norm_y[q][None, :])
        for i, j in np.argwhere(np.abs(sim - cosine) < 1e-12):  # where the order of the sum could matter
            sim[i, j] = (x[p[i]] * y[q[j]]).sum() / (norm_x[p[i]] * norm_y[q[j]])
        hit = sim >= cosine
        if own and a is b:
            hit &= np.triu(np.ones(hit.shape, bool), 1)
        if not hit.any():
            continue
        n[p] += hit @ times_y[q]
        m[q] += times[p] @ hit
        ra, rb = _roots(hit, ids[p].copy(), ids_y[q].copy())
        edges += {(int(i), int(r)) for i, r in [*zip(ids[p], ra), *zip(ids_y[q], rb)] if i != r}
    return (n + m, m, edges) if own else (n, m, edges)


def net(x: np.ndarray, most: int) -> np.ndarray:
    """Centres among the unit vectors ``x`` of which none is near another: at half the radius of all, or the least more that
    gives ``most`` or fewer; at less where that gives one."""
    radius = float(np.sqrt(((x - x[0]) ** 2).sum(axis=1)).max()) / 2
    while radius > 1e-6:
        left, centres = x, []
        while len(left) and len(centres) <= most:
            centres.append(left[0])
            left = left[((left - left[0]) ** 2).sum(axis=1) > radius**2]
        if 1 < len(centres) <= most:
            return np.array(centres)
        radius *= 1.25 if len(centres) > most else 0.6
        if radius > 2:
            break
    return x[:1]


def _unit(flat: pa.Scalar, dim: int) -> np.ndarray:
    x = np.array(flat.values.to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)
    return x / np.sqrt((x**2).sum(axis=1))[:, None]


def divided(rows: DataFrame) -> DataFrame:
    """(label, dim, v, rep, times) with ``path``, the nodes of the cover tree's upper levels that a vector lies in, from the root of
    its label and length down. Nodes of over NODE vectors get children around a net of a bounded sample, level by level; a
    node whose vectors are all alike stays whole. Levels are tables; nothing of them comes to the driver."""
    keys = ["label", "dim"]
    names = [*keys, "v", "rep", "times"]
    open_ = rows.select(*names, F.array(F.xxhash64(*keys)).alias("path"))
    closed = None
    for _ in range(LEVELS):
        sizes = open_.groupBy(F.element_at("path", -1).alias("node")).agg(F.count("*").alias("size"))
        if sizes.where(F.col("size") > NODE).isEmpty():
            return open_ if closed is None else closed.unionByName(open_)
        marked = cut(open_.withColumn("node", F.element_at("path", -1)).join(sizes, "node"), "level")
        small = marked.where(F.col("size") <= NODE).select(*names, "path")
        closed = small if closed is None else closed.unionByName(small)
        marked = marked.where(F.col("size") > NODE)

        def centred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for dim, size, flat in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                    out.append(net(_unit(flat, dim), int(min(FAN, 1 + -(-2 * size // NODE)))).ravel().tolist())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.float64()))], names=["node", "centres"])

        few = marked.where(F.pmod(F.xxhash64("rep"), F.ceil(F.col("size") / SAMPLE)) == 0)
        few = few.groupBy("node", "dim", "size").agg(F.transform(F.array_sort(F.collect_list(F.struct("rep", "v"))), lambda r: r["v"]).alias("vs"))
        centres = few.select("node", "dim", "size", F.flatten("vs").alias("x")).mapInArrow(centred, "node long, centres array<double>")

        def nearest_child(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                child = []
                for dim, flat, mid in zip(batch.column(1).to_pylist(), batch.column(3), batch.column(4)):
                    c = np.array(mid.values.to_numpy(zero_copy_only=False) if mid.is_valid else [], np.float64).reshape(-1, dim)
                    n = len(flat.values) // dim
                    child.append(((_unit(flat, dim) @ c.T).argmax(axis=1) if len(c) > 1 else np.full(n, -1)).tolist())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(child, pa.list_(pa.int64()))], names=["node", "rows", "child"])

        dealt = blocks(marked.select("node", *names, "path"), ["node", "dim"], "rep", BLOCK)
        dealt = dealt.select("node", "dim", "rows", F.flatten(F.transform("rows", lambda r: r["v"])).alias("x")).join(centres, "node", "left")
        kind = dealt.schema["rows"].dataType.simpleString()
        split = dealt.select("node", "dim", "rows", "x", "centres").mapInArrow(nearest_child, f"node long, rows {kind}, child array<long>")
        split = split.select("node", F.explode(F.arrays_zip("rows", "child")).alias("z")).select("z.rows.*", "node", F.col("z.child").alias("child"))
        split = cut(split.withColumn("path", F.when(F.col("child") >= 0, F.array_append("path", F.xxhash64("node", "child"))).otherwise(F.col("path"))), "split")
        split = split.select("label", F.size("v").alias("dim"), "v", "rep", "times", "path", "child")
        closed = closed.unionByName(split.where("child < 0").select(*names, "path"))
        open_ = split.where("child >= 0").select(*names, "path")
    return closed.unionByName(open_)


def near_parts(ball: DataFrame, reach: float) -> DataFrame:
    """(part, path, mid, radius) -> pairs (part_a <= part_b) of parts that may hold vectors within ``reach``, by dual traversal of
    the upper levels from their roots: a pair of nodes goes with all below it if the distance of their centres is more than
    both covering radii and the reach."""
    depth = ball.agg(F.coalesce(F.max(F.size("path")), F.lit(0))).first()[0]
    if not depth:
        return ball.select(F.col("part").alias("part_a"), F.col("part").alias("part_b"))
    apart = lambda p, q: F.sqrt(F.aggregate(F.zip_with(p, q, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    at = lambda i: F.coalesce(F.get("path", F.lit(i)), F.col("part"))  # noqa: E731  what ends above stays itself
    pairs = ball.select(at(0).alias("node_a"), at(0).alias("node_b")).distinct()
    for i in range(1, depth + 1):
        child = ball.select(at(i - 1).alias("node"), at(i).alias("child"), "part", "mid", "radius")
        centre = child.groupBy("node", "child").agg(F.min_by("mid", "part").alias("centre"))
        cover = child.join(centre, ["node", "child"]).groupBy("node", "child", "centre").agg(F.max(apart(F.col("centre"), F.col("mid")) + F.col("radius")).alias("cover"))
        cover = cut(cover, "nodes")
        a, b = (cover.select(F.col("node").alias(f"node_{n}"), F.col("child").alias(f"child_{n}"), F.col("centre").alias(f"centre_{n}"), F.col("cover").alias(f"cover_{n}")) for n in "ab")
        both = pairs.join(a, "node_a").join(b, "node_b").where((F.col("node_a") != F.col("node_b")) | (F.col("child_a") <= F.col("child_b")))
        near = (F.col("child_a") == F.col("child_b")) | (apart(F.col("centre_a"), F.col("centre_b")) <= F.col("cover_a") + F.col("cover_b") + reach)
        pairs = cut(both.where(near).select(F.col("child_a").alias("node_a"), F.col("child_b").alias("node_b")), "pairs")
    return pairs.select(F.least("node_a", "node_b").alias("part_a"), F.greatest("node_a", "node_b").alias("part_b"))


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Vectors of equal, non-null labels link at cosine ``cosine`` or more, exactly. Equal vectors of a label are counted first
    and go on as one. The upper levels of a label's cover tree are tables, down to nodes of at most NODE vectors in blocks;
    pairs of blocks that the levels above leave are joined by dual traversal of their own trees. From a pair of blocks come counts and the edges of its
    components, in proportion to its vectors and not its links. Vectors of unlike length never link. Vectors that are null,
    empty, zero or hold null or non-finite components, and those with a null label, link with nothing. Repeated rows are
    copies; those of one vec_id link as others do. Other columns are ignored. An empty table gives no row.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.withColumn("ok", usable(F.col("v")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    # -0.0 equals 0.0
    good = rows.where("ok").select("vec_id", "label", F.size("v").alias("dim"), F.transform("v", lambda x: x + 0.0).alias("v"))
    same = cut(good.groupBy("label", "dim", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("times")), "same")
    dealt = divided(same).withColumn("node", F.element_at("path", -1))
    parts = cut(blocks(dealt, ["label", "dim", "node"], "rep", BLOCK), "blocks").withColumn("part", F.xxhash64("node", "block")).withColumn("path", F.get("rows", F.lit(0))["path"])
    parts = parts.select("label", "dim", "part", "path", F.transform("rows", lambda r: r["rep"]).alias("ids"), F.transform("rows", lambda r: r["times"]).alias("times"), F.flatten(F.transform("rows", lambda r: r["v"])).alias("x"))

    def balls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mid, radius = [], []
            for dim, flat in zip(batch.column(2).to_pylist(), batch.column(3)):
                u = _unit(flat, dim)
                mid.append(u.mean(axis=0).tolist())
                radius.append(float(np.sqrt(((u - u.mean(axis=0)) ** 2).sum(axis=1)).max()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(mid, pa.list_(pa.float64())), pa.array(radius, pa.float64())], names=["part", "path", "mid", "radius"])

    ball = cut(parts.select("part", "path", "dim", "x").mapInArrow(balls, "part long, path array<long>, mid array<double>, radius double"), "balls")
    pairs = near_parts(ball, float(np.sqrt(max(0.0, 2 - 2 * cosine))) + 1e-6)
    both = pairs.join(parts.select(F.col("part").alias("part_a"), "dim", F.col("ids").alias("ids_a"), F.col("times").alias("times_a"), F.col("x").alias("x_a")), "part_a")
    both = both.join(parts.select(F.col("part").alias("part_b"), F.col("ids").alias("ids_b"), F.col("times").alias("times_b"), F.col("x").alias("x_b")), "part_b")

    def traverse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(i)[k] for i, name in enumerate(batch.schema.names)}
                dim, own = row["dim"].as_py(), row["part_a"] == row["part_b"]
                ids, times, flat = ([np.array(row[f"{n}_{s}"].values.to_numpy(zero_copy_only=False)) for s in "ab"] for n in ("ids", "times", "x"))
                x, y = (f.reshape(-1, dim) for f in flat)
                trees = [cover_tree(v / np.sqrt((v**2).sum(axis=1))[:, None]) for v in ((x,) if own else (x, y))]
                n, m, edges = join_blocks(x, ids[0], times[0], None if own else y, ids[1], times[1], (trees[0], trees[-1]), cosine)
                one = ids[0][n > 0], n[n > 0]
                two = (ids[1][m > 0], m[m > 0]) if not own else (ids[1][:0], m[:0])
                e = np.array(edges, np.int64).reshape(-1, 2)
                first = np.concatenate([one[0], two[0], e[:, 0]])
                second = pa.concat_arrays([pa.nulls(len(first) - len(e), pa.int64()), pa.array(e[:, 1])])
                count = np.concatenate([one[1], two[1], np.zeros(len(e), np.int64)])
                yield pa.RecordBatch.from_arrays([pa.array(first), second, pa.array(count)], names=["a", "b", "n"])

    names = ["part_a", "part_b", "dim", "ids_a", "times_a", "x_a", "ids_b", "times_b", "x_b"]
    links = cut(both.select(names).mapInArrow(traverse, "a long, b long, n long"), "links")
    roots = components(links.where("b is not null").select("a", "b"))
    counts = links.where("b is null").groupBy("a").agg(F.sum("n").alias("n"))
    one = same.join(counts, F.col("rep") == F.col("a"), "left").join(roots, F.col("rep") == F.col("id"), "left")
    one = one.select("label", "dim", "v", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    out = good.join(one, ["label", "dim", "v"]).select("vec_id", "n_links", "component_id")
    out = out.unionByName(rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
