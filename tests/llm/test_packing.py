"""Packing: the curve, the pieces, and every id in exactly one place."""

import itertools
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from llm_docs import make_docs
from treecorpus.llm import packing, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("axes,bits", [(2, 3), (3, 2), (4, 2)])
def test_hilbert_neighbours_differ_by_one_step(axes, bits):
    cells = np.array(list(itertools.product(range(2**bits), repeat=axes)))
    key = packing.hilbert_key(cells, bits)
    assert sorted(key) == list(range(len(cells)))
    walk = cells[np.argsort(key)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_tail_is_powers_of_two():
    for rest in range(0, 1024):
        lengths = packing.tail_lengths(rest)
        assert sum(lengths) == rest and len(set(lengths)) == len(lengths)


def test_long_texts_are_cut_at_boundaries():
    text = "don't stop  now\n\n" * 300 + "x" * 5000 + " end"
    parts = list(tokens.parts(text, 64))
    assert "".join(parts) == text and len(parts) > 50
    tokenizer = Tokenizer.from_file(PATH)
    ids = [i for p in parts for i in tokenizer.encode(p, add_special_tokens=False).ids]
    assert ids == tokenizer.encode(text, add_special_tokens=False).ids


TEXTS = [None, "", "one two", "one two", "a <|endoftext|> b", "z" * 300, *(" ".join(["word", "other"][i % 2:] * (i * 7)) for i in range(40)), "one two"]
IDS = [None, *range(len(TEXTS) - 2), 2]


@pytest.mark.parametrize("size", [16, 1024])
def test_every_id_lies_in_one_piece(spark, size):
    docs = make_docs(spark, TEXTS, IDS).selectExpr("*", "'x' as ids", "1 as row").repartition(3)
    rows = packing.pack(docs, PATH, size).collect()
    tokenizer = Tokenizer.from_file(PATH)
    want = sorted((i if i is not None else -1, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [0])) for i, t in zip(IDS, TEXTS))
    by_sequence = defaultdict(list)
    by_doc = defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length and zlib.crc32(r.ids) >= 0
        by_sequence[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id if r.doc_id is not None else -1].append((r.start, ids))
    total = sum(len(x) for _, x in want)
    assert sorted(x for ids in by_doc.values() for _, part in ids for x in part) == sorted(x for _, ids in want for x in ids)
    lengths = []
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        lengths.append(at)
    assert sum(lengths) == total and all(n == size or n & (n - 1) == 0 for n in lengths)
    for doc, ids in want:
        if doc != 2:  # a repeated row
            assert [x for _, part in sorted(by_doc[doc]) for x in part] == list(ids)


def test_empty(spark):
    assert packing.pack(make_docs(spark, []), PATH).collect() == []
