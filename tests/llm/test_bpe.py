from __future__ import annotations

import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from tilewright.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")
EDGE = ["", None, " ", "\n\n  x", "a" * 3000, "the" * 900, " " * 2000, "!?" * 600, "é" * 1500, "it's we'll 1234 ١٢٣ 漢字仮名 😀👍🏽 \x00\x1c\x85\u200b\u3000z", "<|endoftext|>"]


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_pieces_equal_the_library(reference):
    rng, own = random.Random(2), bpe.codec(PATH, P.PATTERN)
    letters = "ab éßstle\n\t 12'’漢字😀​-_#\r\x1f\x85"
    for _ in range(1500):
        t = "".join(rng.choice(letters) for _ in range(rng.randint(0, 50)))
        assert own.encode(t) == reference.encode_ordinary(t), repr(t)


def test_digests_and_round_trip(docs, clash, reference, monkeypatch):
    df = clash(docs([*EDGE, EDGE[9]]))
    for r, t in zip(bpe.digests(df, PATH, P.PATTERN).orderBy("doc_id").collect(), [*EDGE, EDGE[9]], strict=True):
        ids = reference.encode_ordinary(t or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    ids = bpe.token_ids(df, PATH, P.PATTERN)
    back = {r.doc_id: r.bytes for r in bpe.texts(ids, PATH, P.PATTERN).collect()}
    assert [bytes(back[i]).decode() for i in range(len(EDGE))] == [t or "" for t in EDGE]
    assert bpe.digests(df.limit(0), PATH, P.PATTERN).count() == 0


def test_a_text_with_more_pieces_than_the_cache_holds(monkeypatch, reference):
    monkeypatch.setattr(bpe, "CACHE", 40)
    own = bpe.Codec(bpe.codec(PATH, P.PATTERN).ranks, P.PATTERN)
    text = " ".join(f"w{i}x" for i in range(400))
    ids = reference.encode_ordinary(text)
    assert own.digest(own.split(text))[:2] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())


def test_plain_split_equals_the_general_one():
    """The re module's classes hold what the regex module's properties hold, for every character and at every border."""
    own, rng = bpe.codec(PATH, P.PATTERN), random.Random(4)
    every = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000]
    rng.shuffle(every)
    for lo in range(0, len(every), 997):
        part = every[lo : lo + 997]
        for text in ("".join(part), " ".join(part), "a".join(part), "  \n".join(part), "1!".join(part)):
            assert own.split_plain(text) == own.split_any(text)
    letters = "ab '’sltve12 \t\n\x1c\x85\xa0 éß漢字!?-"
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 30)))
        assert own.split(text) == own.split_plain(text) == own.split_any(text)
    assert own.beyond("a\U0001f600") and not own.beyond("a￿")
    assert own.split("x \U00010400\U00010401 y") == ["x", " \U00010400\U00010401", " y"]
    assert bpe.plain_split(r"\w+|\W") is None and bpe.plain_split(r"[\S]+") is None
