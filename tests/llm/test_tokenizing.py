import os
import random

import pytest

from cairnflow.llm import tokenizing

VOCABULARY = os.environ.get("BPE_VOCABULARY", tokenizing.VOCABULARY)
pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary file")


@pytest.fixture(scope="module")
def peer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


def test_same_ids_as_the_public_library(peer):
    encode = tokenizing.Encoder(tokenizing.load_ranks(VOCABULARY)).encode
    rng = random.Random(1)
    pool = [chr(c) for c in [*range(0x250), *range(0x300, 0x530), *range(0x2000, 0x2100), 0x3000, 0x4E00, 0x1F600, 0xFEFF]]
    pool += [" "] * 300 + ["'s", "<|endoftext|>", "aaaa", "\n\n"] * 20
    for _ in range(1500):
        s = "".join(rng.choice(pool) for _ in range(rng.randrange(40)))
        assert encode(s).tolist() == peer(s), repr(s)


def test_very_long_pre_token(peer):
    encode = tokenizing.Encoder(tokenizing.load_ranks(VOCABULARY)).encode
    s = "ab" * 20_000 + "a" * 30_000
    assert encode(s).tolist() == peer(s)


def test_frame(spark):
    rows = [(1, "Hi there", 5), (2, None, 5), (3, "", 5), (4, " \n ", 5), (1, "Hi there", 6), (None, "é", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = tokenizing.encode_corpus(df, "doc_id", "text", VOCABULARY).collect()
    assert len(got) == 6 and [r.ids for r in got if r.doc_id in (2, 3)] == [[], []]
    assert all(r.ids for r in got if r.doc_id not in (2, 3))
    assert tokenizing.encode_corpus(df.limit(0), "doc_id", "text", VOCABULARY).count() == 0
