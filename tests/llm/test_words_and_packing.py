import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from litlake.llm import _words
from litlake.llm.packing import default_tokenizer, encoder, pack, pieces

AWKWARD = ["", "a", "  \n", "İstanbul É", "naïve — “quoted” 日本語", "x" * 5000, "a<|endoftext|>b", "don't I'LL", " \t\r\n12 ¼²", None]


@given(st.lists(st.text(max_size=60), max_size=6))
@settings(max_examples=60, deadline=None)
def test_words_are_runs_of_word_characters(texts):
    w = _words.words(texts)
    for d, t in enumerate(texts):
        low = _words.lower(t)
        inside = "".join("1" if _words.WORD_CHARS[min(ord(c), len(_words.WORD_CHARS) - 1)] else "0" for c in low)
        spans = [m.span() for m in re.finditer("1+", inside)]
        s = w.of(d)
        assert list(zip(w.starts[s].tolist(), w.ends[s].tolist())) == spans
        same = {}
        for (a, b), h in zip(spans, w.hashes[s].tolist()):
            assert same.setdefault(low[a:b], h) == h


def test_shingles_of_short_texts():
    assert len(_words.shingles(_words.words(["one two"]), 0)) == 1
    assert len(_words.shingles(_words.words([""]), 0)) == 0
    assert len(_words.shingles(_words.words(["a b c d e f"]), 0)) == 2


def test_encoder_gives_the_tokenizers_ids():
    from tokenizers import Tokenizer

    encode, slow = encoder(default_tokenizer()), Tokenizer.from_file(default_tokenizer())
    for t in AWKWARD:
        if t:
            assert encode(t).tolist() == slow.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("n", [1, 2, 1023, 1024, 1025, 5000])
def test_pieces_are_powers_of_two(n):
    p = pieces(n, 1024)
    assert sum(p) == n and all(x & (x - 1) == 0 and x <= 1024 for x in p) and p == sorted(p, reverse=True)


def test_packing_is_an_exact_round_trip(spark):
    rows = [(i, t, "clash") for i, t in enumerate(AWKWARD)] + [(1, "a", "clash"), (None, "null id", "clash")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = pack(df, window=16).collect()
    encode = encoder(default_tokenizer())
    assert len({r["sequence_id"] for r in out}) == len(out) and all(r["offset"] == 0 for r in out)
    for i, t in enumerate(AWKWARD):
        mine = sorted((r for r in out if r["doc_id"] == i), key=lambda r: r["start"])
        if i == 1:
            mine = mine[::2]  # the repeated row's pieces are the same
        ids = np.concatenate([np.frombuffer(r["ids"], "<u4") for r in mine]).tolist()
        assert ids == (encode(t).tolist() if t else []) + [0]
        assert all(r["doc_tokens"] == len(ids) for r in mine)
    assert pack(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        pack(df, window=1000)


def test_very_long_white_space(spark):
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(default_tokenizer())
    texts = [" " * 700_000 + "x", "a" + "\n" * 700_000, "\t " * 350_000 + "1"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in pack(docs).orderBy("doc_id", "start").collect():
        got.setdefault(r["doc_id"], []).append(np.frombuffer(r["ids"], "<u4"))
    for i, t in enumerate(texts):
        assert np.concatenate(got[i]).tolist() == [*slow.encode(t, add_special_tokens=False).ids, 0]
