import base64
import hashlib

import tiktoken

from memloom.llm import bpe as op

from .common import empty, frame, odd_texts, rows_of, words


def test_against_the_library(spark):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(op.RANKS, "rb"))}
    library = tiktoken.Encoding("test", pat_str=op.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = odd_texts() + ["<|endoftext|> isn't  it?   \n\n x", "  lead", "日本語テキスト 123", "​ ﻿"] + [words(30, i) for i in range(40)]
    for chars in (op.CHUNK_CHARS, 500):  # many chunks in a batch
        got = rows_of(op.encode(frame(spark, texts), with_ids=True, chunk_chars=chars))
        assert len(got) == len(texts)
        for i, t in enumerate(texts):
            ids = library.encode_ordinary(t or "")
            assert got[i].ids == ids and got[i].n_tokens == len(ids)
            assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
            assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_round_trip_by_the_token_table(spark):
    texts = ["É ß 𝒳 🙂 naïve", "", "plain words here", "x" * 300]
    encoded = op.encode(frame(spark, texts), ("doc_id", "source"), with_ids=True)
    back = rows_of(op.decode(encoded, ("doc_id", "source")))
    assert [back[i].text for i in range(4)] == texts


def test_empty_and_repeated(spark):
    assert op.encode(empty(spark)).count() == 0
    docs = frame(spark, ["a", "b"])
    assert op.encode(docs.unionAll(docs)).count() == 8
