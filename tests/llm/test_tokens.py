"""Byte-level BPE against the tokenizer library."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import monoid_bpe, queries

RAW = open(public_tokenizers.path(queries.RANK_FILE), "rb").read()
RANKS = monoid_bpe.load_ranks(RAW)
PARTS = monoid_bpe.last_merges(RANKS)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@pytest.mark.parametrize("leaf", [1, 2, 5, 16])
def test_tree_equals_library(leaf):
    coder = monoid_bpe.TreeBpe(RANKS, public_tokenizers.PATTERN, leaf, parts=PARTS)
    rng = random.Random(leaf)
    letters = "aabbé ß\n\t' 1234 　ñthe.,!?中文😀\x85\x1c"
    texts = ["", "a" * 3000, "ab" * 1500, "é" * 900, "'s't <|endoftext|>"] + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 200))) for _ in range(150)]
    for t in texts:
        ids = coder.encode(t)
        assert ids == LIBRARY.encode_ordinary(t)
        assert coder.decode(ids) == t.encode()


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=80))
def test_any_text_round_trips(t):
    coder = monoid_bpe.TreeBpe(RANKS, public_tokenizers.PATTERN, 3, parts=PARTS)
    ids = coder.encode(t)
    assert ids == LIBRARY.encode_ordinary(t) and coder.decode(ids) == t.encode()


def test_every_token_encodes_to_itself_after_its_parts():
    coder = monoid_bpe.TreeBpe(RANKS, public_tokenizers.PATTERN, parts=PARTS)
    assert coder.ordered and not coder.whole
    rng = random.Random(7)
    assert all(coder.reduce(token) == [RANKS[token]] for token in rng.sample(sorted(RANKS), 4000))


def test_seams_equal_merging():
    coder = monoid_bpe.TreeBpe(RANKS, public_tokenizers.PATTERN, parts=PARTS)
    rng = random.Random(8)
    tokens = sorted(RANKS.values())
    common = [RANKS[t] for t in sorted(RANKS) if len(t) <= 3 and t.isalpha()][:400]
    pairs = [(rng.choice(tokens), rng.choice(tokens)) for _ in range(3000)] + [(rng.choice(common), rng.choice(common)) for _ in range(6000)] + [(t, t) for t in common]
    whole = [monoid_bpe.merge_all(coder.bytes_of[a] + coder.bytes_of[b], RANKS) == [a, b] for a, b in pairs]
    assert [coder.seam_holds(a, b) for a, b in pairs] == whole and 100 < sum(whole) < len(pairs) - 100


def test_joins_do_the_merging(monkeypatch):
    coder = monoid_bpe.TreeBpe(RANKS, public_tokenizers.PATTERN, parts=PARTS)
    merged, plain = [], monoid_bpe.merge_all
    monkeypatch.setattr(monoid_bpe, "merge_all", lambda data, ranks: merged.append(len(data)) or plain(data, ranks))
    text = "unbelievably straightforward internationalisation " + "x" * 400
    pieces = coder.findall(text)
    assert coder.encode(text) == LIBRARY.encode_ordinary(text)
    # a piece of k bytes in t tokens takes at least one join for each token of several bytes, and nothing is merged but single bytes and windows
    assert coder.joins >= sum(len(x) > 1 for x in pieces) and merged.count(1) > 0
    assert max(merged) < max(map(len, pieces))


def test_vocabulary_out_of_order():
    ranks = {bytes([k]): k for k in range(256)} | {b"abc": 256, b"bc": 257, b"ab": 258, b"zz": 259, b"xyz": 300}
    coder = monoid_bpe.TreeBpe(ranks, r"[a-z]+")
    assert not coder.ordered and coder.whole == {b"xyz": 300}
    rng = random.Random(9)
    for _ in range(300):
        t = "".join(rng.choice("abcz") for _ in range(rng.randint(1, 30)))
        assert coder.encode(t) == monoid_bpe.merge_all(t.encode(), ranks)
    assert coder.encode("xyz") == [300] and coder.encode("xyza") == list(b"xyza")


def test_join_is_associative():
    coder = monoid_bpe.TreeBpe(RANKS, public_tokenizers.PATTERN, 1, parts=PARTS)
    rng = random.Random(3)
    for _ in range(200):
        a, b, c = (bytes(rng.choice(b"theandingou") for _ in range(rng.randint(0, 12))) for _ in range(3))
        x, y, z = coder.reduce(a) if a else [], coder.reduce(b) if b else [], coder.reduce(c) if c else []
        assert coder.join(coder.join(x, y), z) == coder.join(x, coder.join(y, z)) == (monoid_bpe.merge_all(a + b + c, RANKS) if a + b + c else [])


def test_long_merges_agree():
    rng = random.Random(4)
    for _ in range(30):
        data = bytes(rng.choice(b"thean ") for _ in range(rng.randint(49, 300)))
        assert monoid_bpe.merge_all(data, RANKS) == monoid_bpe.merge_short(data, RANKS)


def test_query_digests(spark, tmp_path):
    texts = ["Hello  world", None, "", "naïve 中文 " * 5000, "Hello  world"]
    rows = spark.createDataFrame([(i, t, "en", "x") for i, t in enumerate(texts)], "doc_id long, text string, token_ids string, decoded string")
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in queries.op4_byte_bpe(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        ids = LIBRARY.encode_ordinary(t or "")
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_operator_keeps_other_columns(spark):
    coder = monoid_bpe.ByteBpe(spark, public_tokenizers.path(queries.RANK_FILE), public_tokenizers.PATTERN)
    rows = spark.createDataFrame([("a b", 7)], "text string, token_ids int")
    out = coder.decode(coder.encode(rows)).first()
    assert bytes(out["decoded"]) == b"a b" and out["text"] == "a b"
    assert coder.encode(rows.limit(0)).collect() == []
