"""Repeated passages: compact windows of min-hashes group passages, enough hashes over one interval make a candidate, texts verify it."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ._shared import cut, text_chunks
from ._words import WIDTH, mix, shingles_of, words

#: Words of the shortest passage that counts, and the least Jaccard similarity of its five-word shingles with the earlier one's.
PASSAGE, SIMILARITY = 50, 0.8
#: Min-hash functions, and how many must agree on an interval of a pair before its texts are compared.
HASHES, AGREE = 8, 2
#: Shingles of the shortest passage, hence of the narrowest compact window.
WINDOW = PASSAGE - WIDTH + 1
#: How far two matches of one passage may shift against each other by insertions and deletions, and the longest unmatched
#: stretch inside a passage, in shingles.
DRIFT, GAP = 48, 24

_SEEDS = mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0xE7037ED1A0B428DB))
_SHORT = (1 << 16) - 1
WINDOW_SCHEMA = "key long, doc long, mark int, place long, context int, rep long, rep_mark int, rep_place long"


def compact_windows(sh: np.ndarray, fences: np.ndarray, seed: np.uint64) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(left, centre, right, min-hash) of the compact windows at least WINDOW wide between fences (True where none may pass).

    These are the nodes of the Cartesian tree over the hashes whose subtree spans WINDOW positions: every stretch inside
    [left, right] that holds the centre has the centre's hash as its minimum. A node qualifies just if it is the minimum of
    some stretch of exactly WINDOW, so a sliding minimum finds them and a stack over these few gives their bounds. Equal
    hashes share a node, of which the first is the centre.
    """
    n = len(sh)
    none = np.empty(0, np.int64)
    if n < WINDOW:
        return none, none, none, np.empty(0, np.uint64)
    h = mix(sh ^ seed)
    order = np.minimum((h >> np.uint64(32)) + np.uint64(1), np.uint64((1 << 32) - 1))
    order[fences] = 0
    # the position in the low bits makes the leftmost of equal hashes the smallest; no text has 2**32 shingles
    v = (order << np.uint64(32)) | np.arange(n, dtype=np.uint64)
    pad = -n % WINDOW
    blocks = np.concatenate([v, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, WINDOW)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    m = np.minimum(back[: n - WINDOW + 1], ahead[WINDOW - 1 : n])
    value = m >> np.uint64(32)
    new = np.ones(len(m), bool)
    new[1:] = value[1:] != value[:-1]
    m, value = m[new], value[new]
    fence = value == 0
    centre = (m & np.uint64((1 << 32) - 1)).astype(np.int64)
    centre[fence] = -1
    # fences stay in the sequence as the smallest values, one for each run of windows that holds any
    left, right = np.empty(len(m), np.int64), np.empty(len(m), np.int64)
    keys, places = value.tolist(), centre.tolist()
    stack: list[int] = []
    for i, x in enumerate(keys):
        if not x:
            stack.clear()
            continue
        while stack and keys[stack[-1]] > x:
            right[stack.pop()] = places[i] - 1
        if stack and keys[stack[-1]] == x:  # the same node again
            fence[i] = True
            continue
        left[i] = places[stack[-1]] + 1 if stack else 0
        right[i] = n - 1
        stack.append(i)
    stops, some = np.flatnonzero(fences), ~fence
    left, right, centre = left[some], right[some], centre[some]
    at = np.searchsorted(stops, centre)
    edge = np.concatenate([[-1], stops, [n]])
    left, right = np.maximum(left, edge[at] + 1), np.minimum(right, edge[at + 1] - 1)
    return left, centre, right, h[centre]


def _packed(left: np.ndarray, centre: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Centre in the high half, the distances to both ends in 16 bits each; a part of a compact window is one as well."""
    return (centre << 32) | (np.minimum(centre - left, _SHORT) << 16) | np.minimum(right - centre, _SHORT)


def named_texts() -> list[Column]:
    """(doc_id, mark, text): rows alike in the first two are taken for copies of one row."""
    text = F.col("text").cast("string")
    return [F.col("doc_id").cast("long").alias("doc_id"), F.hash(text).alias("mark"), text.alias("text")]


def windows(docs: DataFrame) -> DataFrame:
    """Compact windows of all texts; where a chunk of texts has windows with one key and one context in several documents, those
    after the first document are already links to it (``rep``), so a passage of very many documents doesn't meet in one task.
    ``mark``, a hash of the text, tells rows apart that share a doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy()
            for a, b, texts in text_chunks(batch.column(2)):
                w = words(texts)
                long = [d for d in range(b - a) if w.first[d + 1] - w.first[d] >= PASSAGE]
                if not long:
                    continue
                parts = [np.append(shingles_of(w.hashes[w.of(d)]), np.uint64(0)) for d in long]
                sizes = np.array([len(p) for p in parts])
                first = np.concatenate([[0], np.cumsum(sizes)])
                sh = np.concatenate(parts)
                fences = np.zeros(len(sh), bool)
                fences[first[1:] - 1] = True
                doc_of, mark_of = ids[a:b][long].astype(np.int64), marks[a:b][long]
                keys, docs_, marks_, places, contexts = [], [], [], [], []
                for f, seed in enumerate(_SEEDS):
                    left, centre, right, h = compact_windows(sh, fences, seed)
                    d = np.searchsorted(first, centre, "right") - 1
                    around = sh[np.maximum(centre - 7, first[d])] * np.uint64(3) + sh[np.minimum(centre + 7, first[d + 1] - 2)]
                    keys.append((h & ~np.uint64(7)) | np.uint64(f))
                    docs_.append(doc_of[d])
                    marks_.append(mark_of[d])
                    places.append(_packed(left - first[d], centre - first[d], right - first[d]))
                    contexts.append((mix(around) >> np.uint64(33)).astype(np.int64))
                key, doc, mark, place, context = (np.concatenate(x) for x in (keys, docs_, marks_, places, contexts))
                order = np.lexsort((place, mark, doc, context, key))
                key, doc, mark, place, context = key[order], doc[order], mark[order], place[order], context[order]
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (context[1:] != context[:-1])
                head = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
                own = doc[head] == doc
                cols = [pa.array(key.view(np.int64)), pa.array(doc), pa.array(mark), pa.array(place), pa.array(context.astype(np.int32)), *(pa.array(x[head], mask=own) for x in (doc, mark, place))]
                yield pa.RecordBatch.from_arrays(cols, names=["key", "doc", "mark", "place", "context", "rep", "rep_mark", "rep_place"])

    rows = docs.select(*named_texts()).where("doc_id is not null")
    return rows.mapInArrow(run, WINDOW_SCHEMA)


def window_links(made: DataFrame) -> DataFrame:
    """(doc, mark, rep, rep_mark, bit of the hash function, places of both): each window with the first document of its key and
    context, and these with the one before and the smallest of the key. Sorted rows are streamed, so no key's group is held."""
    part = F.when(F.col("rep").isNull(), F.col("key")).otherwise(F.xxhash64("doc", "place"))
    dealt = made.repartition(part).sortWithinPartitions("key", "context", "doc", "mark", "place")
    names = ["key", "context", "doc", "mark", "place"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # key, context, then doc, mark and place of the key's smallest head and of the last context's head
        carried: tuple[int, int, list[int], list[int]] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            done = batch.filter(batch.column(5).is_valid())
            batch = batch.filter(batch.column(5).is_null())
            col = {c: batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i, c in enumerate(names)}
            out = [[done.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 5, 6, 0, 4, 7)]]
            if batch.num_rows:
                if carried is not None and carried[0] == col["key"][0]:  # heads of the batch before stand in front, the smallest first
                    key, context, least, last = carried
                    front = zip(names, zip([key, -2, *least], [key, context, *last]))
                    col = {c: np.concatenate([np.array(x, np.int64), col[c]]) for c, x in front}
                key, context, doc, mark, place = (col[c] for c in names)
                new_key, new = np.ones(len(key), bool), np.ones(len(key), bool)
                new_key[1:] = key[1:] != key[:-1]
                new[1:] = new_key[1:] | (context[1:] != context[:-1])
                head = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
                heads = np.flatnonzero(new)
                # the smallest head of the key among this batch's rows and those carried over
                rank = np.empty(len(heads), np.int64)
                rank[np.lexsort((heads, doc[heads]))] = np.arange(len(heads))
                at = np.empty(len(heads), np.int64)
                at[rank] = heads
                begin = np.flatnonzero(new_key[heads])
                least = at[np.repeat(np.minimum.reduceat(rank, begin), np.diff(np.append(begin, len(heads))))]
                more = np.flatnonzero(~new_key[heads])
                # a copy of a context meets its head; a head meets the head before and the smallest, which is the same for
                # all hash functions, so that their matches add up
                for x, y in ((np.flatnonzero(~new), head[~new]), (heads[more], heads[more - 1]), (heads, least)):
                    swap = doc[x] < doc[y]
                    x, y = np.where(swap, y, x), np.where(swap, x, y)
                    ok = doc[x] != doc[y]
                    x, y = x[ok], y[ok]
                    out.append([doc[x], mark[x], doc[y], mark[y], key[x], place[x], place[y]])
                carried = (int(key[-1]), int(context[-1]), *([int(c[i]) for c in (doc, mark, place)] for i in (least[-1], head[-1])))
            doc, mark, rep, rep_mark, key, place, rep_place = (np.concatenate([np.asarray(o[i], np.int64) for o in out]) for i in range(7))
            cols = (doc, mark.astype(np.int32), rep, rep_mark.astype(np.int32), np.left_shift(1, key & 7), place, rep_place)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["doc", "mark", "rep", "rep_mark", "bit", "place", "rep_place"])

    return dealt.select(*names, "rep", "rep_mark", "rep_place").mapInArrow(run, "doc long, mark int, rep long, rep_mark int, bit long, place long, rep_place long")


def candidates(links: DataFrame) -> DataFrame:
    """(doc, mark, rep, rep_mark, matches): stretches of doc over which AGREE hash functions or more matched with rep at about one shift.

    Links of a pair are first summed by exact shift, map-side, so a copied text costs a row and task, not one for each window.
    """
    centre = F.shiftright("place", 32)
    shift = centre - F.shiftright("rep_place", 32)
    low = F.greatest(centre - F.least(F.shiftright("place", 16).bitwiseAND(_SHORT), F.shiftright("rep_place", 16).bitwiseAND(_SHORT)), F.lit(0))
    high = centre + F.least(F.col("place").bitwiseAND(_SHORT), F.col("rep_place").bitwiseAND(_SHORT))
    # Far apart matches at one shift are told apart by stretches of 4096 shingles, which overlap what they hold.
    rows = links.select("doc", "mark", "rep", "rep_mark", shift.alias("shift"), F.shiftright("place", 44).alias("stretch"), "bit", low.alias("low"), high.alias("high"))
    rows = rows.groupBy("doc", "mark", "rep", "rep_mark", "shift", "stretch").agg(F.bit_or("bit").alias("bits"), F.min("low").alias("low"), F.max("high").alias("high"))
    pairs = rows.groupBy("doc", "mark", "rep", "rep_mark").agg(F.bit_or("bits").alias("bits"), F.collect_list(F.struct("low", "high", "shift", "bits")).alias("matches"))
    return pairs.where(F.bit_count("bits") >= AGREE).drop("bits")


def regions(matches: list[dict]) -> list[tuple[int, int, int, int]]:
    """Interval join of a pair's matches: (low, high, low and high in the other text) of each run of overlapping intervals at
    shifts that drift by DRIFT at most, if AGREE hash functions are in it."""
    out: list[list[int]] = []
    for m in sorted(matches, key=lambda m: (m["low"], m["high"], m["shift"])):
        for r in out:
            if m["low"] <= r[1] + WINDOW and r[2] - DRIFT <= m["shift"] <= r[3] + DRIFT:
                r[1], r[2], r[3], r[4] = max(r[1], m["high"]), min(r[2], m["shift"]), max(r[3], m["shift"]), r[4] | m["bits"]
                break
        else:
            out.append([m["low"], m["high"], m["shift"], m["shift"], m["bits"]])
    return [(a, b, max(0, a - s2), b - s1) for a, b, s1, s2, bits in out if bits.bit_count() >= AGREE]


def passages(own: np.ndarray, start: int, other: np.ndarray, other_start: int) -> list[tuple[int, int, int, int]]:
    """Verified passages between two stretches of shingles: (first shingle, last shingle) of the own and of the other text.

    Shingles that the other stretch holds form runs; runs less than GAP apart are one passage if the Jaccard similarity of the
    shingles of both sides is at least SIMILARITY, else it is split at its widest gap. Passages have at least PASSAGE words.
    """
    where: dict[int, list[int]] = {}
    for j, s in enumerate(other.tolist()):
        where.setdefault(s, []).append(j)
    hit: list[tuple[int, int]] = []
    for i, s in enumerate(own.tolist()):
        if places := where.get(s):
            j = places[0]
            if len(places) > 1 and hit:  # of several, the nearest to where the text goes on
                due = hit[-1][1] + i - hit[-1][0]
                k = bisect_left(places, due)
                j = min(places[max(k - 1, 0) : k + 1], key=lambda x: abs(x - due))
            hit.append((i, j))
    out, todo = [], []
    begin = 0
    for k in range(1, len(hit) + 1):
        if k == len(hit) or hit[k][0] - hit[k - 1][0] > GAP:
            todo.append(hit[begin:k])
            begin = k
    while todo:
        run = todo.pop()
        if not run or run[-1][0] - run[0][0] + 1 < WINDOW:
            continue
        i, j = run[0][0], run[-1][0]
        sides = [y for _, y in run]
        p, q = min(sides), max(sides)
        mine, theirs = set(own[i : j + 1].tolist()), set(other[p : q + 1].tolist())
        both = len(mine & theirs)
        if both >= SIMILARITY * (len(mine) + len(theirs) - both) - 1e-9:
            out.append((start + i, start + j, other_start + p, other_start + q))
            continue
        steps = [(run[k][0] - run[k - 1][0] + abs(run[k][1] - run[k - 1][1]), -k) for k in range(1, len(run))]
        widest = -max(steps)[1]
        todo += [run[:widest], run[widest:]]
    return sorted(out)


def repeated_passages(docs: DataFrame) -> DataFrame:
    """Passages of PASSAGE words or more that nearly repeat one of a document with a smaller doc_id: doc_id, mark (a hash of the
    text), start and end (code points, end exclusive), words, other_id and the passage's start_word and other_word there.

    Near: five-word shingles with Jaccard similarity SIMILARITY or more; words are lower-cased runs of letters and digits. A
    passage is compared with one or a few earlier documents that share its min-hashes, not with all, so a passage of many
    documents gives rows in proportion to them, and its first document none. Repetition within a document, and between
    rows with one doc_id, is not reported; such rows are compared with others each by itself. Null, empty and short texts and
    null ids give no row; ties of min-hashes go to the smallest doc_id, then place. Other columns are ignored. An empty table
    gives no row.
    """
    texts = docs.select(*named_texts()).dropDuplicates(["doc_id", "mark"])
    pairs = cut(candidates(window_links(windows(docs))), "pairs", release=True)

    def regional(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, mark, rep, rep_mark = (batch.column(i).to_pylist() for i in range(4))
            last, text, w = None, "", None
            out: list[tuple] = []
            for i, matches in enumerate(batch.column(4).to_pylist()):
                found = regions(matches)
                if not found:
                    continue
                if (rep[i], rep_mark[i]) != last:
                    last, text = (rep[i], rep_mark[i]), batch.column(5)[i].as_py()
                    w = words([text])
                for a, b, p, q in found:
                    p, q = max(0, p - GAP), min(q + GAP + WIDTH, len(w.starts) - 1)
                    if p <= q:
                        out.append((doc[i], mark[i], rep[i], a, b, p, text[w.starts[p] : w.ends[q]]))
            cols = list(zip(*out)) or [()] * 7
            kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 4, pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["doc", "mark", "rep", "low", "high", "rep_low", "part"])

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, mark, rep, low, high, rep_low = (batch.column(i).to_pylist() for i in range(6))
            out: list[tuple] = []
            last, w, h = None, None, None
            parts: list[np.ndarray] = []  # shingles of the other text's stretches
            for a, b, some in text_chunks(batch.column(6)):
                own = words(some)
                parts += [shingles_of(own.hashes[own.of(d)]) for d in range(b - a)]
            for i in range(batch.num_rows):
                if (doc[i], mark[i]) != last:
                    last, w = (doc[i], mark[i]), words([batch.column(7)[i].as_py()])
                    h = shingles_of(w.hashes)
                a = max(0, low[i] - GAP)
                for x, y, p, _ in passages(h[a : high[i] + GAP + 1], a, parts[i], rep_low[i]):
                    end = y + WIDTH - 1
                    out.append((doc[i], mark[i], int(w.starts[x]), int(w.ends[end]), end - x + 1, rep[i], x, p))
            cols = list(zip(*out)) or [()] * 8
            kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 6]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["doc_id", "mark", "start", "end", "words", "other_id", "start_word", "other_word"])

    of_rep = texts.select(F.col("doc_id").alias("rep"), F.col("mark").alias("rep_mark"), "text")
    one = pairs.join(of_rep, ["rep", "rep_mark"]).select("doc", "mark", "rep", "rep_mark", "matches", "text")
    one = one.mapInArrow(regional, "doc long, mark int, rep long, low long, high long, rep_low long, part string")
    two = one.join(texts.withColumnRenamed("doc_id", "doc"), ["doc", "mark"]).select("doc", "mark", "rep", "low", "high", "rep_low", "part", "text")
    return two.mapInArrow(verified, "doc_id long, mark int, start long, end long, words long, other_id long, start_word long, other_word long")


def merged(found: DataFrame) -> DataFrame:
    """One row per document (doc_id, mark) with a repeated passage: spans (array of start, end; apart and in order), other_ids
    (sorted), removed characters."""
    by = found.groupBy("doc_id", "mark").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("s"), F.sort_array(F.collect_set("other_id")).alias("other_ids"))
    kind = "array<struct<start:bigint,end:bigint>>"
    join = F.aggregate(
        "s",
        F.array().cast(kind),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= x["start"]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end")))),
        ).otherwise(F.concat(acc, F.array(x))),
    )
    out = by.select("doc_id", "mark", join.alias("spans"), "other_ids")
    return out.withColumn("removed", F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"]))


def remove_passages(docs: DataFrame) -> DataFrame:
    """``docs`` with every passage that ``repeated_passages`` finds cut out of ``text``; columns and rows are the same."""
    spans = merged(repeated_passages(docs)).select("doc_id", "mark", "spans")
    rows = docs.select(*named_texts(), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole"))
    n, text = F.size("spans"), F.col("text")
    kept = F.transform(
        F.sequence(F.lit(0), n),
        lambda i: F.substring(
            text,
            F.when(i == 0, 1).otherwise(F.element_at("spans", F.greatest(i, F.lit(1)))["end"] + 1).cast("int"),
            F.greatest(F.when(i == n, F.length(text)).otherwise(F.element_at("spans", F.least(i + 1, n))["start"]) - F.when(i == 0, 0).otherwise(F.element_at("spans", F.greatest(i, F.lit(1)))["end"]), F.lit(0)).cast("int"),
        ),
    )
    whole = rows.join(spans, ["doc_id", "mark"], "left").withColumn("_cut", F.when(F.col("spans").isNull(), text).otherwise(F.array_join(kept, "")))
    return whole.select(*(F.col("_cut").alias(c) if c == "text" else F.col("whole").getField(c).alias(c) for c in docs.columns))
