"""Encoding against the tiktoken library, and an exact round trip."""

import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from relaywright.llm import bpe

RANKS = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(open(RANKS, "rb").read()), special_tokens={})


def texts():
    r = random.Random(2)
    odd = ["", " ", "\n\n  \t", "a", "'s 's", "été ñ 漢字 🙂", "<|endoftext|>", "1234567 12", "x" * 5000, "ab" * 4000, " " * 3000, "é" * 2000]
    return odd + ["".join(r.choice("aabcde é\n.!1漢 ") for _ in range(r.choice([1, 5, 50, 800]))) for _ in range(150)]


def test_matches_library(spark, sf_dir, reference):
    rows = [(i, t) for i, t in enumerate(texts())] + [(900, None), (901, "same"), (901, "same")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, ids string").unionByName(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), allowMissingColumns=True)
    out = bpe.decode(bpe.encode(docs, RANKS, P.PATTERN), RANKS).collect()
    assert len(out) == docs.count()
    for r in out:
        assert r.ids == reference.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()


def test_digests(spark, reference):
    docs = spark.createDataFrame([(1, "Hello été"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in bpe.round_trip(docs, RANKS, P.PATTERN).collect()}
    ids = reference.encode_ordinary("Hello été")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert (got[1].n_tokens, got[1].ids_sha256, got[1].decoded_sha256) == (len(ids), sha(",".join(map(str, ids)).encode()), sha("Hello été".encode()))
    assert (got[2].n_tokens, got[2].ids_sha256, got[2].decoded_sha256) == (0, sha(b""), sha(b""))
    assert bpe.round_trip(docs.limit(0), RANKS, P.PATTERN).count() == 0


def test_long_token_is_fast_and_exact(reference):
    ranks = bpe.load_ranks(open(RANKS, "rb").read())
    piece = "".join(random.Random(1).choice("abcdefgh") for _ in range(60_000))
    assert bpe.merge(piece.encode(), ranks) == reference.encode_ordinary(piece)


def test_many_at_once_and_a_table_that_is_full(reference, monkeypatch):
    """Pre-tokens of a block stand end to end as arrays; those of the block stay known while the tables change places."""
    ranks = bpe.load_ranks(open(RANKS, "rb").read())
    some = [t for t in texts() if t]
    flat, counts = bpe.merge_all([t.encode() for t in some], ranks)
    assert [x.tolist() for x in bpe.np.split(flat, bpe.np.cumsum(counts)[:-1])] == [bpe.merge(t.encode(), ranks) for t in some]
    monkeypatch.setattr(bpe, "KEPT", 40)
    monkeypatch.setattr(bpe, "LISTED_CHARS", 1000)
    merged = bpe.Merged(ranks, bpe.regex.compile(P.PATTERN))
    for block in (texts()[:20], texts()[10:90], [""], texts()):
        flat, counts = merged.encode(block)
        assert len(counts) == len(block)
        assert [x.tolist() for x in bpe.np.split(flat, bpe.np.cumsum(counts)[:-1])] == [reference.encode_ordinary(t) for t in block]
    assert merged.encode([""])[1].tolist() == [0]
