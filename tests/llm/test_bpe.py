import base64
import hashlib

import numpy as np
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from labelmill.llm import bpe

public_tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def by():
    return bpe.codec()


@pytest.fixture(scope="module")
def codec(by):
    return bpe.Codec(*by)


@pytest.fixture(scope="module")
def reference():
    lines = open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read().splitlines()
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(raw):
    return np.frombuffer(raw, "<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=12), st.sampled_from([" ", "  \n", "the", " and", "<|endoftext|>", "<unk>", "▁", "\x00", "aaaaaaaaaaaaaaa", "'ll", "日本語", "😀", "é", "12345"])), max_size=12).map("".join))
def test_any_text_as_the_other_library(codec, reference, text):
    (ids,) = codec.encode([text])
    assert ids_of(ids) == reference.encode_ordinary(text)
    assert codec.decode(ids) == text.encode()


def test_every_token_and_long_texts(codec, reference, monkeypatch):
    texts = [t.decode() for t in codec.raw if "�" not in t.decode("utf-8", "replace")]
    texts += ["x" * 30_000, " " * 5000, "ab " * 20_000, "日本" * 3000, ""]
    assert [ids_of(i) for i in codec.encode(texts)] == [reference.encode_ordinary(t) for t in texts]
    monkeypatch.setattr(bpe, "LONG_TEXT", 10)
    monkeypatch.setattr(bpe, "AT_ONCE", 7)
    monkeypatch.setattr(bpe, "KNOWN", 20)
    some = texts[::500]
    assert [ids_of(i) for i in codec.encode(some)] == [reference.encode_ordinary(t) for t in some]


def test_bytes_are_mapped_one_to_one():
    every = bytes(range(256))
    assert len(set(bpe.mapped(every))) == 256 and bpe.unmapped(bpe.mapped(every)) == every
    assert not regex.search(r"\s", bpe.mapped(every))


def test_incomplete_vocabulary_is_refused(tmp_path):
    path = tmp_path / "few.tiktoken"
    path.write_bytes(b"\n".join(base64.b64encode(bytes([b])) + f" {b}".encode() for b in range(255)))
    with pytest.raises(ValueError):
        bpe.read_ranks(str(path))


def test_nasty_rows(spark, nasty, nothing, by, reference):
    docs = nasty.withColumn("ids", F.lit("clash"))
    rows = bpe.decoded(bpe.encoded(docs, by), by).collect()
    assert len(rows) == docs.count()
    for r in rows:
        text = r.text or ""
        assert ids_of(r.ids) == reference.encode_ordinary(text) and r.n_tokens == len(r.ids) // 4 and bytes(r.decoded) == text.encode()
    assert bpe.decoded(bpe.encoded(nothing, by), by).count() == 0
    assert hashlib.sha256(rows[0].decoded).hexdigest()
