"""Pre-tokenisation, stitching and round trips against the published libraries."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import regex
import tiktoken
from hypothesis import given, settings, strategies as st

from llm_docs import make_docs
from treecorpus.llm import bpe, tokens

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = regex.compile(public_tokenizers.PATTERN)


def engine():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


PIECES = st.lists(st.sampled_from([*" \n\ta'sdtrevml12é　!?漢🙂", "'s", "'ll", "'re", "  ", "\r\n", "word"]), max_size=12)


@settings(max_examples=300, deadline=None)
@given(st.lists(PIECES.map("".join), min_size=1, max_size=4))
def test_boundaries_are_those_of_the_pattern(texts):
    texts = [t for t in texts if t]
    points = [tokens.code_points(t) for t in texts]
    starts = np.r_[0, np.cumsum([len(p) for p in points])][:-1].astype(int)
    want = [s + m.start() for s, t in zip(starts, texts) for m in PATTERN.finditer(t)]
    got = tokens.boundaries(np.concatenate(points), starts).tolist() if texts else []
    assert got == want


def hard_texts():
    rnd = random.Random(3)
    words = ["the", "they're", "x1", "  ", "\n\n", "naïve", "漢字", "!!", "🙂", "a", "\t", "͸", "don't"]
    mixed = [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 400))) for _ in range(30)]
    return [None, "", "a", " ", "x" * 900, " " * 700 + "end", "ab " * 500, "x" * 100 + " " + "'s" * 400, *mixed, mixed[0]]


def test_chunks_stitch_to_the_whole_encoding(spark):
    texts = hard_texts()
    docs = make_docs(spark, texts, [None, *range(len(texts) - 2), 7]).withColumn("doc", docs_clash()).repartition(3)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.ids_sha256, r.decoded_sha256)
                 for r in bpe.round_trip(docs, PATH, public_tokenizers.PATTERN, chunk=100, overlap=40).collect())
    enc, want = engine(), []
    for i, t in zip([-1, *range(len(texts) - 2), 7], texts):
        ids = enc.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)


def docs_clash():
    from pyspark.sql import functions as F
    return F.lit("a column that clashes")


def test_empty_table(spark):
    assert bpe.round_trip(make_docs(spark, []), PATH, public_tokenizers.PATTERN).collect() == []
