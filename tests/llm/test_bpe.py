import hashlib
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foldwright.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.load_ranks(PATH), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


@settings(max_examples=300, deadline=None)
@given(text=st.text(alphabet=st.characters(max_codepoint=0x2FF) | st.sampled_from("aeio thn'll  \n\t12éß日本<|>"), max_size=300))
def test_same_ids_and_round_trip(codec, reference, text):
    ids = codec.encode(text)
    assert ids == reference.encode_ordinary(text)
    assert codec.decode(ids) == text.encode()
    assert codec.decode_joined(",".join(map(str, ids))) == text.encode()


@pytest.mark.parametrize("n", [1, 2, 1000, 60_000])
def test_long_pretokens(codec, reference, n):
    rng = random.Random(n)
    for text in ("a" * n, "".join(rng.choice("aeinrst") for _ in range(n)), "日" * (n // 3)):
        assert codec.encode(text) == reference.encode_ordinary(text)


@pytest.mark.parametrize("seed", range(40))
def test_any_table_merges_the_lowest_rank_first(monkeypatch, seed):
    """Tables whose ranks don't follow the order of construction, against the plain loop."""
    monkeypatch.setattr(bpe, "QUEUE_SYMBOLS", 30)
    rng = random.Random(seed)
    tokens = [bytes([b]) for b in range(256)]
    while len(tokens) < 300:
        t = rng.choice(tokens[97:100] + tokens[256:]) + rng.choice(tokens[97:100] + tokens[256:])
        if t not in tokens:
            tokens.append(t)
    tail = tokens[256:]
    rng.shuffle(tail)
    ranks = {t: i for i, t in enumerate(tokens[:256] + tail)}
    pieces = [bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 14))) for _ in range(60)]

    def plain(piece):
        if piece in ranks:
            return [ranks[piece]]
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while True:
            found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
            if not found:
                return [ranks[p] for p in parts]
            _, i = min(found)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    codec = bpe.Codec(ranks, ".+")
    assert dict(codec.encode_many(pieces)) == {i: plain(p) for i, p in enumerate(pieces)}


def test_cache_turns_over(codec, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_SIZE", 4)
    for j in range(9):
        text = " ".join(f"zq{i}xk" for i in range(j, 3 * j + 2))
        assert codec.decode(codec.encode(text)) == text.encode()


def test_documents(spark, reference):
    rows = [(1, "hello  world", "x", 5), (None, None, None, None), (2, "", "y", 0), (2, "", "y", 0), (3, "naïve <|endoftext|> 日本語" * 50, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string, ids int")
    out = bpe.encode_documents(docs, PATH, public_tokenizers.PATTERN, digests=True)
    got = sorted(map(tuple, out.collect()), key=str)
    want = []
    for i, t, _, _ in rows:
        ids = reference.encode_ordinary(t or "")
        want.append((i, len(ids), ids, hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    back = bpe.decode_documents(out.select("doc_id", "ids"), PATH)
    assert {(r["doc_id"], bytes(r["decoded"])) for r in back.collect()} == {(i, (t or "").encode()) for i, t, _, _ in rows}
    assert bpe.encode_documents(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
