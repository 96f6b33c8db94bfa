"""Packing by power-of-two decomposition: no sequence crosses documents."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

#: How byte-level vocabularies split a text before merging.
BYTE_LEVEL = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("ids", T.BinaryType()),
    ]
)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _alphabet() -> dict[str, int]:
    """The printable stand-in of every byte in byte-level vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=4)
def encoder(path: str) -> Callable[[str], np.ndarray]:
    """text -> ids (uint32), as ``Tokenizer.from_file(path).encode(text, add_special_tokens=False)`` gives them.

    A plain byte-level BPE file whose ids are merge ranks runs in tiktoken's faster merge loop, with the same ids (a test
    compares both); any other file runs in tokenizers.
    """
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)

    def plain(text: str) -> np.ndarray:
        return np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    byte, vocab = _alphabet(), {k: v for k, v in model["vocab"].items() if k not in special}
    in_order = model["type"] == "BPE" and all(vocab.get("".join(m if isinstance(m, list) else m.split(" "))) == 256 + i for i, m in enumerate(model["merges"]))
    if not (in_order and not spec.get("normalizer") and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and all(c in byte for k in vocab for c in k)):
        return plain
    import tiktoken

    quick = tiktoken.Encoding("from_json", pat_str=BYTE_LEVEL, mergeable_ranks={bytes(byte[c] for c in k): v for k, v in vocab.items()}, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if any(s in text for s in special):
            return plain(text)
        try:
            return quick.encode_to_numpy(text, disallowed_special=())
        except ValueError:  # its splitting pattern gives up on very long white space
            return plain(text)

    return encode


def pieces(n: int, window: int) -> list[int]:
    """Lengths for n ids: whole windows, then the binary digits of the rest from the largest."""
    rest = n % window
    return [window] * (n // window) + [1 << b for b in range(window.bit_length() - 2, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = 1024, end_id: int = 0) -> DataFrame:
    """Sequences of at most ``window`` ids (a power of two) without padding, each from one document.

    A document's ids, closed by ``end_id``, are cut at the binary digits of their number, so that every piece has a
    power of two as its length and is a sequence by itself; sequences of one length form a bucket, from which batches
    without padding are drawn. Columns: doc_id, start, length (its bucket), doc_tokens, ids (little-endian unsigned
    32-bit), sequence_id, offset (always 0). sequence_id follows the rows' place in the scan.

    Null or empty text: the closing id alone. A null doc_id is kept. Repeated rows are packed once each. Columns beyond
    doc_id and text are ignored. Very long texts become many windows. An empty table gives no row.
    """
    if window < 1 or window & (window - 1):
        raise ValueError("window must be a power of two")
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            texts = batch.column(1)
            for at in range(0, batch.num_rows, 512):
                some = texts.slice(at, 512).to_pylist()
                keys = batch.column(0).slice(at, 512)
                out: dict[str, list] = {k: [] for k in ("row", "start", "length", "total")}
                buffers = []
                for row, text in enumerate(some):
                    ids = encode(text) if text else np.empty(0, np.uint32)
                    buffers += [ids.astype("<u4", copy=False), np.array([end_id], "<u4")]
                    total, start = len(ids) + 1, 0
                    for length in pieces(total, window):
                        for k, v in (("row", row), ("start", start), ("length", length), ("total", total)):
                            out[k].append(v)
                        start += length
                data = np.concatenate(buffers) if buffers else np.empty(0, "<u4")
                length = np.array(out["length"], np.int64)
                offsets = np.concatenate([[0], np.cumsum(length * 4)]).astype(np.int32)
                ids = pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(out["row"], pa.int64())), pa.array(out["start"], pa.int64()), pa.array(length), pa.array(out["total"], pa.int64()), ids],
                    names=SCHEMA.names,
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA).withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
