"""SentencePiece encoding over a relational lattice of substrings and pieces, folded by Spark's higher-order functions."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..tables import bucketed, cut
from ._shared import text_chunks

#: Stands for a space.
SPACE = "▁"
#: Boundaries are kept as bits, WORD of them in a number; no piece may be longer.
WORD = 60
#: Bytes of text of a pass, in which each unit is named once; bounds memory, not what is processed.
PASS = 12_000_000
#: Units at most, and characters and ids of a unit at most, of the broadcast part of the ids; all others come by a join.
TABLE, TABLE_CHARS, TABLE_IDS = 200_000, 32, 32


@dataclass
class Model:
    """What encoding needs of a model file: pieces with scores, kinds of ids, its algorithm and its treatment of the text."""

    pieces: list[str]
    scores: list[float]
    kind: list[str]  # normal, byte or other
    bpe: bool
    unknown: int
    prefix: bool = True
    ids: dict[str, int] = field(default_factory=dict)
    bytes_: list[int] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kind)) if k == "normal"}
        named = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kind)) if k == "byte"}
        self.bytes_ = [named[f"<0x{b:02X}>"] for b in range(256)] if len(named) == 256 else []
        self.longest = max(map(len, self.ids), default=1)
        if self.longest >= WORD:
            raise ValueError(f"a piece of {WORD} characters or more")

    def spell(self, text: str) -> list[int]:
        """Ids of what no piece covers."""
        return [self.bytes_[b] for b in text.encode()] if self.bytes_ else [self.unknown]

    def neighbours(self) -> tuple[np.ndarray, np.ndarray]:
        """(class of each code point, whether a class may follow another inside a piece); class 0 is in no pair."""
        pairs = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        chars = {c: i + 1 for i, c in enumerate(sorted({c for p in pairs for c in p}))}
        number = np.zeros(0x110000, np.int32)
        for c, i in chars.items():
            number[ord(c)] = i
        follows = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        for a, b in pairs:
            follows[chars[a], chars[b]] = True
        return number, follows


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def load(path: str) -> Model:
    """Models with identity normalisation that keep extra white space and have no user-defined pieces; others are refused."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    spec = pb.ModelProto()
    with open(path, "rb") as f:
        spec.ParseFromString(f.read())
    norm, n = spec.normalizer_spec, p.get_piece_size()
    if norm.precompiled_charsmap or norm.remove_extra_whitespaces or spec.trainer_spec.model_type not in (1, 2) or any(x.type == 4 for x in spec.pieces):
        raise ValueError("not a plain BPE or unigram model")
    kind = ["byte" if p.is_byte(i) else "other" if p.is_control(i) or p.is_unknown(i) or p.is_unused(i) else "normal" for i in range(n)]
    return Model([p.id_to_piece(i) for i in range(n)], [p.get_score(i) for i in range(n)], kind, spec.trainer_spec.model_type == 2, p.unk_id(), norm.add_dummy_prefix)


def split_units(texts: list[str | None], model: Model, tables: tuple[np.ndarray, np.ndarray]) -> tuple[list[str], np.ndarray]:
    """(units of all texts, how many each text has). A unit is a stretch of which every two neighbours stand in some piece side
    by side; no piece reaches over its ends, so units are encoded apart from each other, like words but shorter."""
    number, follows = tables
    spaced = [(SPACE if model.prefix else "") + t.replace(" ", SPACE) if t else "" for t in texts]
    joined = "".join(spaced)
    first = np.concatenate([[0], np.cumsum([len(t) for t in spaced])]).astype(np.int64)
    if not joined:
        return [], np.zeros(len(texts), np.int64)
    kind = number[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    new = np.ones(len(joined), bool)
    new[1:] = ~follows.ravel().take(kind[:-1] * np.int32(len(follows)) + kind[1:])
    new[first[:-1][first[:-1] < len(joined)]] = True
    starts = np.flatnonzero(new)
    at = starts.tolist()
    return [joined[a:b] for a, b in zip(at, [*at[1:], len(joined)])], np.diff(np.searchsorted(starts, first))


def lattice(units: DataFrame, model: Model) -> DataFrame:
    """Rows with a column ``unit`` get ``edges``: the pieces among its substrings, by rank, then start. For BPE an edge is one
    number, of the rank's place, the start and the size; for unigram models a struct of rank, start and end.

    Substrings of bounded length are exploded and joined to the piece table, which is broadcast: its size is the model's. A
    marker row for each unit stays without a piece, so that none is lost. Grouping by unit needs no shuffle if the units come
    dealt by ``unit``. For BPE single characters are no edges, as merges start from them."""
    places = {x: k for k, x in enumerate(sorted({-model.scores[i] for i in model.ids.values()}))}
    table = units.sparkSession.createDataFrame([(p, -float(model.scores[i]), places[-model.scores[i]]) for p, i in model.ids.items()], "name string, rank double, place long")
    table = table.select(F.xxhash64("name").alias("hash"), "*")
    least = 2 if model.bpe else 1
    sizes = model.longest - least + 1
    names = units.columns
    # one number for each start and size, and -1 for the marker: all that follows is compiled into one loop
    rows = units.select(F.monotonically_increasing_id().alias("_row"), "*", F.length("unit").alias("_n")).select("*", F.explode(F.sequence(F.lit(-1), F.col("_n") * sizes - 1)).alias("i"))
    rows = rows.withColumns({"s": F.when(F.col("i") < 0, -1).otherwise((F.col("i") / sizes).cast("int")), "_size": F.col("i") % sizes + least})
    rows = rows.where((F.col("i") < 0) | (F.col("s") + F.col("_size") <= F.col("_n")))
    rows = rows.select("_row", *names, "s", (F.col("s") + F.col("_size")).alias("e"), F.when(F.col("i") >= 0, F.substring("unit", F.col("s") + 1, F.col("_size"))).alias("piece"))
    # numbers are looked up much faster than texts, which are compared as well
    rows = rows.withColumn("_hash", F.xxhash64("piece")).join(F.broadcast(table), (F.col("_hash") == F.col("hash")) & (F.col("piece") == F.col("name")), "left").where((F.col("s") < 0) | F.col("name").isNotNull())
    if model.bpe:
        edge = F.when(F.col("s") >= 0, _shift("shiftleft", F.col("place"), F.lit(40)) + _shift("shiftleft", F.col("s").cast("long"), F.lit(8)) + (F.col("e") - F.col("s")))
    else:
        edge = F.when(F.col("s") >= 0, F.struct("rank", "s", "e"))
    # the number in front has the rows in order already where the aggregation sorts them
    return rows.groupBy("_row", *names).agg(F.sort_array(F.collect_list(edge)).alias("edges")).drop("_row")


def _shift(how: str, x: Column, by: Column) -> Column:
    return F.call_function(how, x, by)


def fold_merges(rows: DataFrame) -> DataFrame:
    """BPE: ``cuts``, the boundaries left between a unit's characters, as bits of an array of numbers.

    Merges are made by rank, then start, and each joins two neighbouring parts. One fold over the edges in that order takes
    every edge that spans just two parts at its turn. That is the right order of merges unless an edge that spanned more at
    its turn could be taken later, which needs that at most one boundary is left inside it at the end; units with such an
    edge are folded step by step, each step searching all edges. Boundaries are bits of one number in units of less than WORD
    characters and of several in longer ones; the fold is the same.
    """
    one, n = F.lit(1).cast("long"), F.length("unit")
    start = lambda x: _shift("shiftright", x, F.lit(8)).bitwiseAND((1 << 32) - 1)
    size = lambda x: x.bitwiseAND(255).cast("int")
    number = lambda x: F.floor(start(x) / WORD).cast("int")  # noqa: E731  which of the numbers has the start's bit
    off = lambda x: (start(x) % WORD).cast("int")

    def inner(x: Column) -> Column:
        return _shift("shiftleft", one, size(x)) - 2

    def seen_one(cuts: Column, x: Column) -> Column:
        return _shift("shiftright", cuts, start(x).cast("int")).bitwiseAND(_shift("shiftleft", one, size(x) + 1) - 1)

    def merged_one(cuts: Column, x: Column) -> Column:
        return cuts.bitwiseAND(F.bitwise_not(_shift("shiftleft", inner(x), start(x).cast("int"))))

    def seen_many(cuts: Column, x: Column) -> Column:
        both = _shift("shiftright", F.get(cuts, number(x)), off(x)).bitwiseOR(_shift("shiftleft", F.get(cuts, number(x) + 1), WORD - off(x)))
        return both.bitwiseAND(_shift("shiftleft", one, size(x) + 1) - 1)

    def merged_many(cuts: Column, x: Column) -> Column:
        low, high = _shift("shiftleft", inner(x), off(x)), _shift("shiftright", inner(x), WORD - off(x))
        return F.transform(cuts, lambda w, i: F.when(i == number(x), w.bitwiseAND(F.bitwise_not(low))).when(i == number(x) + 1, w.bitwiseAND(F.bitwise_not(high))).otherwise(w))

    def folded(every: Column, kind: str, seen: Callable[[Column, Column], Column], merged: Callable[[Column, Column], Column]) -> Column:
        """``seen``: the boundaries from the start of an edge to its end, its start lowest."""

        def parts(cuts: Column, x: Column) -> Column:
            """How many parts an edge spans; 0 if one of its ends is no boundary."""
            now, ends = seen(cuts, x), _shift("shiftleft", one, size(x)) + 1
            return F.when(now.bitwiseAND(ends) == ends, F.bit_count(now) - 1).otherwise(0)

        def turn(state: Column, x: Column) -> Column:
            p = parts(state["cuts"], x)
            return (
                F.when(p == 2, F.struct(merged(state["cuts"], x).alias("cuts"), state["wait"].alias("wait")))
                .when(p > 2, F.struct(state["cuts"].alias("cuts"), F.array_append(state["wait"], x).alias("wait")))
                .otherwise(state)
            )

        def step(state: Column, _: Column) -> Column:
            free = F.filter(state["edges"], lambda x: parts(state["cuts"], x) == 2)
            cuts = F.when(F.size(free) > 0, merged(state["cuts"], F.get(free, F.lit(0)))).otherwise(state["cuts"])
            return F.struct(cuts.alias("cuts"), state["edges"].alias("edges"))

        def done(state: Column) -> Column:
            late = F.exists(state["wait"], lambda x: F.bit_count(seen(state["cuts"], x).bitwiseAND(inner(x))) <= 1)
            slow = F.aggregate(F.sequence(F.lit(1), n), F.struct(every.alias("cuts"), F.col("edges")), step, lambda x: x["cuts"])
            return F.when(late, slow).otherwise(state["cuts"])

        begin = F.struct(every.alias("cuts"), F.array().cast("array<bigint>").alias("wait")).cast(f"struct<cuts:{kind},wait:array<bigint>>")
        return F.aggregate("edges", begin, turn, done)

    one_number = folded(_shift("shiftleft", one, n + 1) - 1, "bigint", seen_one, merged_one)
    full = F.lit((1 << WORD) - 1)
    numbers = F.transform(F.sequence(F.lit(0), (n / WORD).cast("int") + 1), lambda i: F.when(n + 1 >= (i + 1) * WORD, full).when(n + 1 > i * WORD, _shift("shiftleft", one, n + 1 - i * WORD) - 1).otherwise(F.lit(0)).cast("long"))
    return rows.withColumn("cuts", F.when(n < WORD, F.array(one_number)).otherwise(folded(numbers, "array<bigint>", seen_many, merged_many)))


def fold_viterbi(rows: DataFrame, unknown: float) -> DataFrame:
    """Unigram: ``back``, for each end position where the last piece of the best path to it starts. The fold goes over end
    positions; for each the best edge that ends there, or one unknown character, continues the best path to its start."""
    ended = F.map_from_entries(F.transform(F.sequence(F.lit(1), F.length("unit")), lambda e: F.struct(e.alias("key"), F.filter("edges", lambda x: x["e"] == e).alias("value"))))
    rows = rows.withColumn("_by", ended)

    def step(acc: Column, e: Column) -> Column:
        some = F.transform(F.col("_by")[e], lambda x: F.struct((F.get(acc["score"], x["s"]) - x["rank"]).alias("v"), (-x["s"]).alias("s")))
        other = F.struct((F.get(acc["score"], e - 1) + unknown).alias("v"), (1 - e).alias("s"))
        best = F.array_max(F.concat(some, F.array(other)))
        return F.struct(F.array_append(acc["score"], best["v"]).alias("score"), F.array_append(acc["back"], -best["s"]).alias("back"))

    start = F.struct(F.array(F.lit(0.0)).alias("score"), F.array(F.lit(0)).alias("back")).cast("struct<score:array<double>,back:array<int>>")
    return rows.withColumn("back", F.aggregate(F.sequence(F.lit(1), F.length("unit")), start, step, lambda acc: acc["back"])).drop("_by")


def segmented(units: DataFrame, model: Model) -> DataFrame:
    """``units`` with edges and a column of the best segmentation: ``cuts`` for BPE, ``back`` for unigram models."""
    made = lattice(units, model)
    if model.bpe:
        return fold_merges(made)
    return fold_viterbi(made, min((model.scores[i] for i in model.ids.values()), default=0.0) - 10)


def ids_of(unit: str, found: list[int], model: Model) -> list[int]:
    """The ids of a unit from what ``segmented`` found."""
    if model.bpe:
        bits = sum(w << WORD * i for i, w in enumerate(found))
        at = [i for i in range(len(unit) + 1) if bits >> i & 1]
    else:
        at = [len(unit)]
        while at[-1]:
            at.append(found[at[-1]])
        at.reverse()
    out: list[int] = []
    for s, e in zip(at, at[1:]):
        i = model.ids.get(unit[s:e])
        out += [i] if i is not None else model.spell(unit[s:e])
    return out


def spelled(units: DataFrame, model: Model) -> DataFrame:
    """(unit, n) with ``ids``, 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.array(ids_of(u, f, model), np.int32).tobytes() for u, f in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.binary())], names=["unit", "n", "ids"])

    return segmented(units, model).select("unit", "n", "cuts" if model.bpe else "back").mapInArrow(run, "unit string, n long, ids binary")


def _packed(x: np.ndarray) -> bytes:
    """32-bit numbers, byte by byte of them, compressed."""
    return pa.Codec("zstd", compression_level=6).compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), asbytes=True)


def _unpacked(x: bytes, n: int) -> np.ndarray:
    flat = np.frombuffer(pa.decompress(x, n * 4, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(flat.reshape(4, n).T).view("<u4").ravel()


class _Numbers(dict):
    """Numbers by unit; a new one gets the next."""

    __slots__ = ()

    def __missing__(self, unit: str) -> int:
        n = self[unit] = len(self)
        return n


def _joined(*parts: bytes) -> bytes:
    """Parts with their lengths in front."""
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def _parted(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 8], "little")
        out.append(data[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def unit_counts(docs: DataFrame, model: Model) -> DataFrame:
    """(unit, n) of all texts, n how often it occurs; counted by pass before units meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = model.neighbours()
        found: Counter[str] = Counter()
        size = 0
        for batch in batches:
            for a, b, texts in text_chunks(batch.column(1)):
                found.update(split_units(texts, model, tables)[0])
                size += sum(len(t or "") for t in texts)
                if size >= PASS:
                    yield from named(found)
                    found, size = Counter(), 0
        yield from named(found)

    def named(found: Counter[str]) -> Iterator[pa.RecordBatch]:
        units, n = pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())
        for i in range(0, len(units), 50_000):
            yield pa.RecordBatch.from_arrays([units.slice(i, 50_000), n.slice(i, 50_000)], names=["unit", "n"])

    return docs.mapInArrow(run, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))


def common(units: DataFrame) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
    """(place, lengths, ids one after another) of the most frequent units, TABLE at most: those whose count is past a bound taken
    from a histogram. Short ones only, so that this has a bound in bytes whatever the data."""
    fit = units.where((F.length("unit") <= TABLE_CHARS) & (F.octet_length("ids") <= 4 * TABLE_IDS)).withColumn("bin", F.floor(F.log2("n") * 8).cast("int"))
    bound, total = None, 0
    for r in sorted(fit.groupBy("bin").count().collect(), key=lambda r: -r["bin"]):
        if (total := total + r["count"]) > TABLE:
            break
        bound = r["bin"]
    if bound is None:
        return {}, np.zeros(0, np.int64), np.zeros(0, np.int32)
    hot = fit.where(F.col("bin") >= bound).select("unit", "ids", "n").toArrow().sort_by([("n", "descending"), ("unit", "ascending")])
    ids = [np.frombuffer(x, np.int32) for x in hot.column("ids").to_pylist()]
    return {u: i for i, u in enumerate(hot.column("unit").to_pylist())}, np.array([len(x) for x in ids], np.int64), np.concatenate(ids)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (array<int>) and text_crc32 (of the text's UTF-8) of every row, as the model's own library encodes it.

    Texts are split into units, over whose ends no piece reaches. The corpus's distinct units go through the lattice once;
    their ids come back to each pass of documents by a join on the unit, but for the most widespread ones, whose ids are
    broadcast (at most TABLE short ones). A model whose algorithm is BPE merges by score, where a best path of scores gives
    other ids, so it is folded by merges; a unigram model is folded by Viterbi. Units of any length take the same way.

    Null or empty text: no ids. Repeated rows are encoded each, ids of documents aren't keys of anything; other columns are
    ignored; texts are encoded whole. An empty table gives no row.
    """
    model = load(path or default_model())
    return _encoded(docs, model, lambda batch: batch, "doc_id {kind}, ids array<int>, text_crc32 long")


def _encoded(docs: DataFrame, model: Model, then: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """``encode``, with each batch of its result passed on through ``then`` in the worker that made it."""
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    units = cut(spelled(unit_counts(rows, model), model), "units", release=True)
    shared = docs.sparkSession.sparkContext.broadcast(common(units))
    names = ["unit", "pass", "k", "data"]

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each pass a row for each unit that isn't common (unit, its number k), and one for its documents (without a unit): their
        ids and sums, how many units each has, and which, common ones first."""
        tables = model.neighbours()
        place = shared.value[0]
        name = TaskContext.get().partitionId() << 32
        for batch in batches:
            for a, b in _ranges(batch.column(1), PASS):
                number = _Numbers(place)
                codes, sizes, crcs = [], [], []
                for _, _, texts in text_chunks(batch.column(1).slice(a, b - a)):
                    parts, each = split_units(texts, model, tables)
                    codes.append(np.fromiter(map(number.__getitem__, parts), np.uint32, len(parts)))
                    sizes.append(each)
                    crcs += [zlib.crc32((t or "").encode()) for t in texts]
                # in order, as like units that follow each other take less room in a shuffle
                rest = pa.array(list(islice(number, len(place), None)), pa.string())
                order = pc.sort_indices(rest).to_numpy()
                rest = rest.take(pa.array(order))
                renamed = np.arange(len(number), dtype=np.uint32)
                renamed[len(place) + order] = renamed[len(place) :].copy()
                for i in range(0, len(rest), 50_000):
                    n = min(50_000, len(rest) - i)
                    yield pa.RecordBatch.from_arrays([rest.slice(i, n), pa.array(np.full(n, name)), pa.array(np.arange(i, i + n, dtype=np.int32)), pa.nulls(n, pa.binary())], names=names)
                docs_ = pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(crcs, pa.int64()), pa.array(np.concatenate(sizes), pa.int64())], names=["doc_id", "crc", "size"])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, docs_.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                    writer.write_batch(docs_)
                data = _joined(len(rest).to_bytes(8, "little"), sink.getvalue().to_pybytes(), _packed(renamed[np.concatenate(codes)]))
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.array([name], pa.int64()), pa.array([-1], pa.int32()), pa.array([data], pa.binary())], names=names)
                name += 1

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The units of each pass that have met their ids in this task, packed."""
        held: list[pa.RecordBatch] = []

        def packed() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            name, k, data = t.column(0).to_numpy(), t.column(1).to_numpy(), t.column(2).combine_chunks()
            passes, out = np.unique(name), []
            for x in passes:
                own = np.flatnonzero(name == x)
                own = own[np.argsort(k[own], kind="stable")]
                ids = data.take(pa.array(own))
                size = pc.binary_length(ids).to_numpy() // 4
                out.append(_joined(_packed(np.diff(k[own], prepend=0)), len(own).to_bytes(8, "little"), _packed(size), _packed(np.frombuffer(b"".join(ids.to_pylist()), np.uint32))))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(passes), pa.array(out, pa.binary())], names=["pass", "part"])

        for batch in batches:
            held.append(batch)
            if sum(h.num_rows for h in held) >= 200_000:
                yield packed()
        if held:
            yield packed()

    def assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each pass's documents with the ids of its common and of its own units."""
        _, hot_size, hot_ids = shared.value
        for batch in batches:
            for data, parts in zip(batch.column(0), batch.column(1)):
                count, docs_, codes = _parted(data.as_py())
                size = np.concatenate([hot_size, np.zeros(int.from_bytes(count, "little"), np.int64)])
                start, flat = np.empty(len(size), np.int64), [hot_ids]
                start[: len(hot_size)] = np.cumsum(hot_size) - hot_size
                begin = len(hot_ids)
                for part in parts.as_py() or ():
                    k, n, sizes, ids = _parted(part)
                    n = int.from_bytes(n, "little")
                    k, sizes = np.cumsum(_unpacked(k, n), dtype=np.int64) + len(hot_size), _unpacked(sizes, n).astype(np.int64)
                    size[k], start[k] = sizes, begin + np.cumsum(sizes) - sizes
                    flat.append(_unpacked(ids, int(sizes.sum())).view(np.int32))
                    begin += len(flat[-1])
                flat = np.concatenate(flat)
                ids, crcs, each = pa.ipc.open_stream(docs_).read_next_batch().columns
                each = each.to_numpy()
                codes = _unpacked(codes, int(each.sum()))
                ends = np.cumsum(each)
                a = 0
                while a < len(ids):  # some documents at a time
                    b = max(a + 1, int(np.searchsorted(ends, ends[a] + 300_000)))
                    c = codes[ends[a] - each[a] : ends[b - 1]]
                    n = size[c]
                    at = np.cumsum(n) - n
                    got = flat[np.repeat(start[c] - at, n) + np.arange(int(n.sum()))]
                    edges = np.concatenate([at, [len(got)]])[np.concatenate([[0], ends[a:b] - ends[a] + each[a]])]
                    yield then(pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(got, pa.int32())), crcs.slice(a, b - a)], names=["doc_id", "ids", "text_crc32"]))
                    a = b

    made = bucketed(rows.mapInArrow(coded, "unit string, pass long, k int, data binary"), "coded", "pass")
    # few and plain columns: each row's share of a batch is measured on its way to Python
    own = made.where("k >= 0").select("unit", "pass", "k").join(units.select("unit", "ids"), "unit").select("pass", "k", "ids")
    own = own.mapInArrow(gathered, "pass long, part binary").groupBy("pass").agg(F.collect_list("part").alias("parts"))  # a pass's units
    whole = made.where("k < 0").select("pass", "data").join(own, "pass", "left").select("data", "parts")
    return whole.mapInArrow(assembled, schema.format(kind=kind))


def _ranges(column: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``most`` bytes of text each."""
    begin = size = 0
    for i, n in enumerate(pc.binary_length(column).fill_null(0).to_pylist()):
        if i > begin and size + n > most:
            yield begin, i
            begin, size = i, 0
        size += n
    if len(column) > begin:
        yield begin, len(column)


def decode_ids(ids: np.ndarray, model: Model, spelled: list[bytes] | None = None) -> str:
    """The text of ids: pieces joined, bytes as they are (what isn't UTF-8 replaced), control ids nothing."""
    spelled = spelled or spellings(model)
    text = b"".join([spelled[i] for i in ids.tolist()]).decode("utf-8", "replace").replace(SPACE, " ")
    return text[1:] if model.prefix and text.startswith(" ") else text


def spellings(model: Model) -> list[bytes]:
    number = {i: b for b, i in enumerate(model.bytes_)}
    return [p.encode() if k == "normal" else bytes([number[i]]) if k == "byte" else (" ⁇ ".encode() if i == model.unknown else b"") for i, (p, k) in enumerate(zip(model.pieces, model.kind))]


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """Rows with ``ids`` (array<int>) get ``text``, which is replaced if there; null ids give null. Other columns stay."""
    model = load(path or default_model())
    rows = encoded.drop("text")
    names = rows.columns
    at = names.index("ids")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), "text string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelled = spellings(model)
        for batch in batches:
            text = [decode_ids(x.values.to_numpy(zero_copy_only=False), model, spelled) if x.is_valid else None for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.string())], names=[*names, "text"])

    return rows.mapInArrow(run, schema)


def digest(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Of every document: doc_id, n_ids, ids_crc32 (of the ids as little-endian 32-bit numbers), and whether decoding gives
    the text again. A text that has SPACE itself doesn't come back, as it stands for a space."""
    model = load(default_model())
    spelled: list[bytes] = []

    def summed(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not spelled:
            spelled.extend(x.replace(SPACE.encode(), b" ") for x in spellings(model))
        n, crc, same = [], [], []
        for x, want in zip(batch.column(1), batch.column(2).to_pylist()):
            ids = x.values.to_numpy(zero_copy_only=False)
            n.append(len(ids))
            crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
            text = b"".join(map(spelled.__getitem__, ids.tolist()))
            same.append(zlib.crc32(text[1:] if model.prefix and text[:1] == b" " else text) == want)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())], names=["doc_id", "n_ids", "ids_crc32", "round_trip"])

    return _encoded(docs, model, summed, "doc_id {kind}, n_ids long, ids_crc32 long, round_trip boolean")
