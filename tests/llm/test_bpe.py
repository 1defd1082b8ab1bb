import base64

import pytest
from hypothesis import given, settings, strategies as st

from loomqa.llm import bpe

PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@pytest.fixture(scope="module")
def ours():
    return bpe.Encoder(bpe.load_ranks(open(PATH, "rb").read()))


@pytest.fixture(scope="module")
def public():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_same_ids_and_round_trip(ours, public):
    strings = {v: k for k, v in ours.ranks.items()}

    @settings(max_examples=300, deadline=None)
    @given(st.text(max_size=80))
    def check(t):
        ids = ours.encode(t)
        assert ids == public.encode_ordinary(t) and bpe.decode(ids, strings) == t

    check()
    for t in ("aaaa" * 2000, "<|endoftext|> 'll  \n\n x", "日本語" * 200, "é" * 3000):
        assert ours.encode(t) == public.encode_ordinary(t)


def test_operator_edges(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, " ", 0), (3, "a b", 0)], "doc_id long, text string, ids int")
    got = sorted((r.doc_id, r.ids) for r in bpe.encode_corpus(df, "doc_id", "text", PATH).collect())
    assert got == [(1, []), (2, []), (3, [64, 275]), (3, [220])]
    assert bpe.encode_corpus(df.limit(0), "doc_id", "text", PATH).count() == 0


def test_decoded_corpus_and_the_vocabulary_for_many_languages(spark):
    multi = PATH.replace("byte_bpe_50k", "byte_bpe_multi_50k")
    texts = [(1, None), (2, ""), (3, "Größe, ещё 日本語 <|endoftext|>\n\n  x"), (4, "🙂 é" * 500)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    for path in (PATH, multi):
        ids = bpe.encode_corpus(df, "doc_id", "text", path)
        assert {r.doc_id: r.text for r in bpe.decode_corpus(ids, "doc_id", "ids", path).collect()} == {k: t or "" for k, t in texts}
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(multi, "rb"))}
    public = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert {r.doc_id: r.ids for r in bpe.encode_corpus(df, "doc_id", "text", multi).collect()} == {k: public.encode_ordinary(t or "") for k, t in texts}
