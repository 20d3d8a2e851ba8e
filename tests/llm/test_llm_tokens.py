import random

import brute
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from formline.llm import queries, tokens
from formline.llm.common import table

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: len(tokenizer.encode(text or "", add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def counter():
    return tokens.Counter(tokens.read_vocabulary(PATH))


def test_query_equals_the_library(spark, sf, library):
    rows = {r.doc_id: r for r in queries.QUERIES["op11_token_counts"](spark, sf).collect()}
    docs = table(spark, sf, "documents").collect()
    assert len(rows) == len(docs)
    for d in docs:
        n = library(d.text)
        assert rows[d.doc_id][1:] == (len((d.text or "").encode()), n, n > 2048)


def test_edge_rows_in_tiny_batches(spark, library, monkeypatch):
    """Nulls, empty and very long texts, repeated rows, clashing names; batches and memory far too small for the texts."""
    extra = [(20, "a <|endoftext|>b<|startoftext|><|endoftext|"), (21, "<|EndOfText|>"), (22, "it's WE'LL he'd \x1c\x1d\x85 tab\tend"), (23, "é" * 700 + " é"), (24, "ſ İ ΣΑΣ ﬁ 日本語 👩‍👩‍👧")]
    rows = [*brute.EDGE, *extra]
    for name, value in (("HELD_BYTES", 64), ("BATCH_SYMBOLS", 8), ("REMEMBERED", 3), ("SHORT_CHUNK", 4)):
        monkeypatch.setattr(tokens, name, value)
    found = tokens.count_tokens(brute.edge_docs(spark, rows), PATH, limit=5)
    assert found.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = sorted(((i, len((t or "").encode()), library(t), library(t) > 5) for i, t in rows), key=repr)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == want


def test_empty_table(spark):
    assert tokens.count_tokens(brute.edge_docs(spark, []), PATH).collect() == []


def test_random_texts(counter, library):
    rnd = random.Random(3)
    letters = "abcdefst  '’SİΣς013é́ß\x1c\x85᠎ 日국🙂!?.<|>\t\n\x00\x7f"
    texts = ["".join(rnd.choices(letters, k=rnd.randrange(40))) + rnd.choice(["", "<|endoftext|>x", "<|startoftext|>"]) for _ in range(4000)]
    assert counter.count([t.encode() for t in texts]) == [library(t) for t in texts]


@pytest.mark.parametrize("text", ["a" * 3001, "ab" * 2000, "the" * 999, "1" * 700, "!" * 1500])
def test_long_sequences(counter, library, text):
    assert counter.count([text.encode()]) == [library(text)]


def test_both_ways_of_merging_agree(counter):
    rnd = np.random.default_rng(5)
    words = ["".join(rnd.choice(list("abcdeinrst"), n)) for n in rnd.integers(1, 90, 300)]
    ragged = counter.count_words(words)
    for word, n in zip(words, ragged):
        symbols = counter.inner[[ord(c) for c in word]]
        symbols[-1] = counter.last[ord(word[-1])]
        assert tokens.merge_long(symbols, counter.merges) == n


def test_merges_out_of_order_are_refused():
    vocab = {s: k for k, s in enumerate(["a", "b", "c", "ab", "abc"])}
    with pytest.raises(ValueError, match="later merge"):
        tokens.Merges(vocab, [["ab", "c"], ["a", "b"]])
