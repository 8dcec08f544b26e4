import hashlib
import random
import time

import public_tokenizers as P
import pytest
import tiktoken

from rowscope.llm import matching
from tests.conftest import spark  # noqa: F401

FILES = ("byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module", params=FILES)
def both(request):
    own = matching.load(P.path(request.param))
    return own, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=own.rank, special_tokens={})


def test_equals_the_library_on_odd_texts(both):
    own, lib = both
    r = random.Random(5)
    tokens = list(own.rank)
    for k in range(4000):
        text = (
            "".join(r.choice("abcdefghijklmnopqrstuvwxyzthe") for _ in range(r.randint(1, 40))),
            b"".join(r.choice(tokens) for _ in range(r.randint(1, 6))).decode("utf-8", "replace"),
            "".join(chr(r.choice([r.randint(0, 126), r.randint(0x80, 0x2FFF), r.randint(0x4E00, 0x9FFF), r.randint(0x1F300, 0x1F6FF)]))
                    for _ in range(r.randint(1, 30))),
            r.choice(["a", "ab", " ", "\n", " \n", "é", "=", "ha", "-="]) * r.randint(1, 60),
            "".join(r.choice(["é", "à", "th", "er", "の", "日", "本", " ", "1", "23", "'s"]) for _ in range(r.randint(1, 30))),
        )[k % 5]
        ids = own.encode(text)
        assert ids == lib.encode_ordinary(text), repr(text)
        assert own.decode(ids) == text.encode()


def test_long_pretokens_take_linear_time(both):
    own, lib = both
    r = random.Random(1)
    for text in ("a" * 200_000, "".join(r.choice("abcdefgh") for _ in range(200_000)), " " * 200_000):
        start = time.perf_counter()
        ids = own.encode(text)
        assert time.perf_counter() - start < 5
        assert ids == lib.encode_ordinary(text)


def test_query_equals_the_library(spark, edge_docs, no_docs):  # noqa: F811
    own = matching.load()
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=own.rank, special_tokens={})
    want = []
    for row in edge_docs.collect():
        ids = lib.encode_ordinary(row.text or "")
        want.append((row.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256((row.text or "").encode()).hexdigest()))
    assert sorted(map(str, map(tuple, matching.digest(edge_docs).collect()))) == sorted(map(str, want))
    assert matching.digest(no_docs).count() == 0 and matching.encode(no_docs).count() == 0
    assert all(bytes(r.decoded).decode() == (r.text or "") for r in matching.encode(edge_docs).join(
        edge_docs.select("doc_id", "text").distinct(), "doc_id").where("doc_id not in (5, 7)").collect())
