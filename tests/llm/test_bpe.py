import base64
import random

import numpy as np
import pyarrow as pa
import pytest
import tiktoken

from glyphmill.llm import bpe
from glyphmill.llm.common import slices

from .helpers import awkward, table

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@pytest.fixture(scope="module")
def oracle():
    with open(bpe.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts(n):
    r = random.Random(0)
    signs = [*"aebsdtmlvr  '''\n\t12!?.,éßñ 　 中٣½Z\r\x1c\x85\U0001f600́", "'s", "'ll", "'ve", "'re", "  ", "the ", "\n\n"]
    made = ["".join(r.choice(signs) for _ in range(r.randint(0, 40))) for _ in range(n)]
    return [*made, "", "a" * 5000, " " * 3000 + "x", "!" * 1000, "x" * 300 + "\n" * 300, "'", "'s", " 's", "!'s"]


def test_equals_the_regex_tokenizer(oracle):
    tool = bpe.codec(bpe.read_vocabulary(bpe.VOCABULARY))
    all_texts = texts(6000)
    for first, data, at in slices(pa.array(all_texts)):
        ids, offsets, bounds = tool.encode(data, at)
        for i in range(len(at) - 1):
            text = all_texts[first + i]
            own = ids[bounds[i] : bounds[i + 1]]
            assert own.tolist() == oracle.encode_ordinary(text), repr(text)
            assert tool.decode(own) == text.encode()
            raw, begin = text.encode(), offsets[bounds[i] : bounds[i + 1]]
            for lo in range(0, len(own), 7):  # any range of tokens is found at its offset
                at_, piece = tool.span(own, begin, lo, lo + 3)
                assert raw[at_ : at_ + len(piece)] == piece


def test_scan_equals_stepping():
    r = random.Random(1)
    numbers = bpe.tables()[3]
    for n in (1, 2, 511, 512, 513, 5000, 300_000):
        symbols = np.array([r.randrange(8) for _ in range(n)], np.uint8)
        state, want = bpe.DONE, []
        for s in symbols.tolist():
            state = bpe.step(state, s)[0]
            want.append(state)
        assert bpe.scan(numbers[0].take(symbols)).tolist() == want


def test_merges_of_long_pieces_agree():
    tool = bpe.codec(bpe.read_vocabulary(bpe.VOCABULARY))
    r = random.Random(2)
    pieces = [bytes(r.choice(b"abst ein") for _ in range(r.randint(1, 39))) for _ in range(500)]
    assert [np.frombuffer(x, np.int32).tolist() for x in tool.merge(pieces)] == [tool._long(p) for p in pieces]


def test_documents(spark, oracle):
    rows = awkward()
    out = bpe.encode_documents(table(spark, rows, extra=True)).collect()
    assert len(out) == len(rows)
    want = sorted(((d, None if t is None else oracle.encode_ordinary(t)) for d, t, *_ in rows), key=repr)
    assert sorted(((r["doc_id"], r["ids"]) for r in out), key=repr) == want
    assert all((r["round_trip"], r["n_tokens"]) == ((None, None) if r["ids"] is None else (True, len(r["ids"]))) for r in out)
    back = bpe.decode_ids(bpe.encode_documents(table(spark, rows)).select("doc_id", "ids"))
    assert sorted(((r["doc_id"], r["text"]) for r in back.collect()), key=repr) == sorted(((d, t) for d, t, *_ in rows), key=repr)
    assert bpe.encode_documents(table(spark, [])).count() == 0
