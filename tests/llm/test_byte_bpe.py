import hashlib
import struct

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from threadloom.llm import byte_bpe as b

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def own():
    with open(PATH, "rb") as f:
        return b.TextEncoder(f.read(), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(own):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})


PIECES = st.sampled_from(["a", "the", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "é", "́", "'s", "1", "²", "!!", "<|endoftext|>", "日本", "😀", "\r\n", "　", "x" * 90, "ab" * 70, "=-" * 60])


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=60), st.lists(PIECES, max_size=25).map("".join)))
def test_same_ids_as_the_library(own, library, text):
    ids = library.encode_ordinary(text)
    packed = own.encode(text)
    assert packed == struct.pack(f"<{len(ids)}I", *ids)
    assert own.decode(packed) == text.encode()


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abethin", min_size=1, max_size=300))
def test_halves_joined_equal_plain_merging(own, text):
    data = text.encode()
    assert own.tree.encode(data) == own.tree.leaf(data) == own.tree.long_leaf(data)


def test_very_long_match(own, library):
    for text in ("a" * 20_000, "abcde" * 4_000):
        assert own.encode(text) == struct.pack(f"<{len(library.encode_ordinary(text))}I", *library.encode_ordinary(text))


def test_table(odd_docs, no_docs, library):
    found = b.encode(odd_docs, PATH, public_tokenizers.PATTERN)
    rows = found.collect()
    texts = sorted(hashlib.sha256((r.text or "").encode()).hexdigest() for r in odd_docs.collect())
    assert sorted(r.decoded_sha256 for r in rows) == texts
    assert all(r.n_tokens == len(r.ids) and r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(r.ids)}I", *r.ids)).hexdigest() for r in rows)
    decoded = b.decode_ids(found, PATH).collect()
    assert sorted(hashlib.sha256(bytes(r.decoded)).hexdigest() for r in decoded) == texts
    assert b.encode(no_docs, PATH, public_tokenizers.PATTERN).count() == 0
