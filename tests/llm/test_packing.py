import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from juryframe.llm import packing
from juryframe.llm.packing import Encoder, binary_pieces, pack_documents, vocabulary
from juryframe.llm.queries import op2_packing


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def encode():
    return Encoder("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t a'sé<|endoftext|>1.　\x1c\x85"), st.characters(codec="utf-8")), max_size=40))
def test_ids_are_the_tokenizers(tokenizer, encode, text):
    assert np.frombuffer(encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_special_token_in_a_text(tokenizer, encode):
    for text in ("a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y z"):
        assert np.frombuffer(encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@given(st.integers(0, 20000))
def test_pieces(n):
    pieces = list(binary_pieces(n, 2048))
    assert sum(length for _, length in pieces) == n
    at = 0
    for start, length in pieces:
        assert start == at and length & (length - 1) == 0 and length <= 2048
        at += length
    rest = [length for _, length in pieces if length < 2048]
    assert len(rest) == len(set(rest)) == bin(n % 2048).count("1")


def check(found, texts, tokenizer):
    by_doc = defaultdict(list)
    for r in found:
        by_doc[r["doc_id"]].append(r)
    for doc, text in texts.items():
        ids, at = tokenizer.encode(text or "", add_special_tokens=False).ids + [1], 0
        for r in sorted(by_doc[doc], key=lambda r: r["start"]):
            part = ids[at : at + r["length"]]
            assert (r["start"], r["doc_tokens"], r["offset"]) == (at, len(ids), 0)
            assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes()) and 2 ** r["bucket"] == r["length"]
            at += r["length"]
        assert at == len(ids)
    assert len({r["sequence_id"] for r in found}) == len(found)


def test_odd_rows(documents, odd_rows, tokenizer):
    found = pack_documents(documents(odd_rows)).collect()
    check([r for r in found if r["doc_id"] not in (9, None)], {i: t for i, t, _, _ in odd_rows if i not in (9, None)}, tokenizer)
    assert len({r["sequence_id"] for r in found}) == len(found)
    twice = [(r["start"], r["ids_crc32"]) for r in found if r["doc_id"] == 9]
    assert all(twice.count(x) == 2 for x in twice)


def test_long_white_space(documents, tokenizer):
    texts = {1: " \n" * 500_000, 2: "a" + " " * 1_200_000 + "b", 3: "x" + "\u3000\t" * 600_000, 4: "a " * 1000}
    check(pack_documents(documents([(i, t, "en", "a") for i, t in texts.items()])).collect(), texts, tokenizer)


def test_kept_parts_are_bounded_by_bytes(monkeypatch, tokenizer):
    monkeypatch.setattr(packing, "KEPT_BYTES", 2_000)
    encode = Encoder("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")
    for i in range(50):
        text = f"some {i} word{i} " + "y" * 1_500
        assert np.frombuffer(encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
        assert sum(map(len, encode.parts)) <= 2_000 and encode.kept <= 4_000


def test_worker_stays_small(monkeypatch, documents, prose):
    """Copies are encoded once, texts whole, the tokenizer is loaded where it is needed, and pieces leave in small batches."""
    calls, text = [], " ".join(f"{prose(3, i)} w{i}" for i in range(500))
    encode = Encoder("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")
    own = encode._encode
    monkeypatch.setattr(encode, "_encode", lambda t: (calls.append(t), own(t))[1])
    assert encode(text) == encode(text) and calls == [text] and "whole" not in vars(encode)
    assert encode("<|endoftext|>") and "whole" in vars(encode)
    monkeypatch.setattr(packing, "BATCH_PIECES", 4)
    rows = pack_documents(documents([(i, prose(50 + i, i), "en", "a") for i in range(20)]).coalesce(1)).collect()
    assert sorted(r["sequence_id"] for r in rows) == [*range(len(rows))] and {r["doc_id"] for r in rows} == {*range(20)}


def test_buckets(documents, odd_rows):
    places = defaultdict(list)
    for r in pack_documents(documents(odd_rows).coalesce(1)).collect():
        places[r["bucket"]].append(r["bucket_place"])
    assert all(sorted(p) == [*range(len(p))] for p in places.values())


def test_real_ids(documents):
    rows = pack_documents(documents([(1, "one two three", "en", "a")]), with_ids=True).collect()
    assert [x for r in rows for x in r["ids"]][-1] == 1 and all(len(r["ids"]) == r["length"] for r in rows)


def test_empty(documents):
    assert pack_documents(documents([])).count() == 0


def test_length_must_be_a_power(documents):
    with pytest.raises(ValueError):
        pack_documents(documents([]), longest=1000)


def test_query(spark, sf_dir, tokenizer):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    check(op2_packing(spark, sf_dir).collect(), texts, tokenizer)
