from __future__ import annotations

import hashlib
import random

import pytest

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")

from ledgermill.llm import bpe  # noqa: E402

PATH = public.path("word_bpe_49k.json")
ODD = "aáÁbBéèê ñ'sdr  1²٣İΣςß'́\n\t漢字🙂ﬁ!?…'llVE\x1c\x85​"


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


def test_random_texts_like_the_library(library):
    own, rng = bpe.WordBpe.load(PATH), random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choice(ODD) for _ in range(rng.randint(0, 40)))
        if rng.random() < 0.2:
            text = text[:7] + "<|endoftext|>" + text[7:] + "<|startoftext|>"
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_memory_has_no_effect(library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    own = bpe.WordBpe.load(PATH)
    text = "one two three four five two one " * 5
    assert own.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_digests_of_odd_rows(spark, library):
    texts = [None, "", "   ", "same text", "same text", "word " * 30_000, "x" * 20_000, "<|endoftext|>"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    got = {r.doc_id: r for r in bpe.encoding_digests(docs, PATH).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encoding_digests(docs.limit(0), PATH).count() == 0


def test_round_trip(spark, library):
    docs = spark.createDataFrame([(1, "Hello, wörld"), (2, None)], "doc_id long, text string")
    rows = bpe.decoded(bpe.encoded(docs, PATH), PATH).orderBy("doc_id").collect()
    assert rows[0].decoded == library.decode(rows[0].token_ids, skip_special_tokens=False)
    assert rows[1].token_ids == []
    assert rows[1].decoded == ""
