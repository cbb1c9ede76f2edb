import hashlib
import random
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from dialogmeter.llm import bpe_codec
from dialogmeter.llm.bpe_codec import WordCodec, default_tokenizer, encode_texts
from dialogmeter.llm.store import worker_cache
from dialogmeter.llm.token_counts import CountTransducer, count_tokens, default_pieces

ODD = [
    "", " ", "İΣΑΣ ΌΔΟΣ", "á ë", "<|endoftext|> x<|startoftext|>y <|foo|>", "  a  b ", "\x1c\x1d \x85  x", "日本語 🎉👍🏽",
    "a" * 40, "!!!!!!??? '''s 'll I'VE", "\0 a\0b", "x" * 3000, "ﬁ ǅ ß ẞ ſ K", "a\n\n b \nc", "▁▁ ▁a", "\t x　y",
]


@pytest.fixture(scope="module")
def codec():
    return WordCodec(default_tokenizer())


@pytest.fixture(scope="module")
def counter():
    return CountTransducer(default_pieces())


@pytest.fixture(scope="module")
def pieces():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=default_pieces())


def agree(codec, texts):
    for text, (ids, decoded) in zip(texts, codec.encode(texts), strict=True):
        want = codec.library.encode(text, add_special_tokens=False).ids
        assert ids == struct.pack(f"<{len(want)}I", *want), text
        assert decoded == codec.library.decode(want, skip_special_tokens=False), text


def test_codec_equals_library_on_odd_texts_and_every_letter(codec):
    agree(codec, ODD + ["a" + chr(c) + "b " + chr(c) for c in range(0x3000)])


def test_codec_equals_library_on_random_words(codec):
    rng = random.Random(3)
    agree(codec, ["".join(rng.choice("aábcdeïthingraon  '!?\n\t0129éß<|>") for _ in range(rng.randint(1, 60))) for _ in range(800)])


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_codec_and_counts_equal_libraries_on_any_text(codec, counter, pieces, text):
    agree(codec, [text])
    assert counter.counts([text])[0] == len(pieces.encode(text))


def test_counts_equal_library(counter, pieces):
    rng = random.Random(4)
    texts = ODD + [" " * n + "a" + " " * (7 * n) for n in range(30)] + ["▁" * n for n in range(20)]
    texts += ["".join(rng.choice("aábcdeïthingraon  '!?\n\t0129éß▁ <|>日") for _ in range(rng.randint(1, 80))) for _ in range(800)]
    assert list(counter.counts(texts)) == [len(pieces.encode(t)) for t in texts]


def test_counts_survive_full_memos(counter, pieces, monkeypatch):
    monkeypatch.setattr(CountTransducer, "STATES", 20)
    monkeypatch.setattr(CountTransducer, "CHUNKS", 5)
    texts = ["supercalifragilistic" * 20 + " word", "another one entirely", "x" * 500]
    for _ in range(2):
        assert list(counter.counts(texts)) == [len(pieces.encode(t)) for t in texts]


def test_queries_on_edge_rows(spark, docs_of, codec, pieces):
    long = "word and another, " * 20_000
    docs = docs_of([(1, None), (2, ""), (3, "Hello  World"), (3, "Hello  World"), (None, "x"), (5, long)]).withColumnRenamed("n_chars", "n_tokens")
    got = encode_texts(docs).collect()
    assert len(got) == 6
    by = {r.doc_id: r for r in got}
    assert by[1].n_tokens == by[2].n_tokens == 0 and by[1].decoded == ""
    assert by[1].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert list(by[5].ids) == codec.library.encode(long, add_special_tokens=False).ids
    counted = {r.doc_id: r for r in count_tokens(docs).collect()}
    assert counted[1].n_tokens == 0 and counted[1].n_bytes == 0 and not counted[1].over_limit
    assert counted[5].n_tokens == len(pieces.encode(long)) and counted[5].over_limit
    assert counted[5].n_bytes == len(long)
    empty = docs.limit(0)
    assert encode_texts(empty, with_ids=False).count() == 0 and count_tokens(empty).count() == 0


def test_a_worker_drops_what_it_kept_of_another_operator():
    path = default_tokenizer()
    first = bpe_codec.codec(path)
    assert bpe_codec.codec(path) is first
    worker_cache("toxicity")
    assert bpe_codec.codec(path) is not first
