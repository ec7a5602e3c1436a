import random
import time

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sitefacts.llm import packing, token_counts

PIECES = (
    "a B ß é É Σ ς İ 日本 😀 's 'S 'll 12 ٣ ½ <|endoftext|> <|startoftext|> <| - ... ! ﬁ the tion Ⅷ 가 \x00 \x7f µ Å \x1c \x85 \xa0"
).split(" ") + [" ", "  ", "\n", "\n\n", "\t", "\r\n", "​", "é"]


@pytest.fixture(scope="module")
def word_vocabulary():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_counts_equal_the_library(word_vocabulary):
    own, rng = token_counts.counter(), random.Random(5)
    for _ in range(4000):
        text = "".join(rng.choices(PIECES, k=rng.randint(0, 12)))
        assert own.chunk_counts(text).sum() == len(word_vocabulary.encode(text, add_special_tokens=False).ids), repr(text)


def test_word_prefixes_are_exact(word_vocabulary):
    own = token_counts.counter()
    for word in ("internationalization", "thntrestble", "können", "aaaaaaaaaaaa"):
        exact = [len(word_vocabulary.encode(word[:k], add_special_tokens=False).ids) for k in range(1, len(word) + 1)]
        assert own.word_prefixes(word) == exact


def test_budget_needs_no_second_encoding(word_vocabulary, words):
    own, text = token_counts.counter(), words(60, 1)
    for budget in (0, 1, 7, 40, 10_000):
        size = own.fitting_prefix(text, budget)
        assert len(word_vocabulary.encode(text[:size], add_special_tokens=False).ids) <= budget
        if size < len(text):
            assert len(word_vocabulary.encode(text[: size + 1], add_special_tokens=False).ids) > budget


def test_rows(spark, make_docs, words):
    long = words(50_000, 2)
    docs = make_docs([(1, None), (2, ""), (3, "the cat"), (3, "the cat"), (None, "x"), (5, long)])
    rows = {r.doc_id: r for r in token_counts.count_tokens(docs, with_prefixes=True).collect()}
    assert (rows[1].n_tokens, rows[2].n_tokens, rows[3].n_tokens, rows[None].n_bytes) == (0, 0, 2, 1)
    assert rows[3].prefixes == [0, 1, 2] and rows[5].over_limit and not rows[3].over_limit
    assert rows[5].prefixes[-1] == rows[5].n_tokens
    assert token_counts.count_tokens(docs).count() == 6
    assert token_counts.count_tokens(docs.limit(0)).count() == 0


def test_encoder_equals_the_library():
    own, rng = packing.encoder(), random.Random(6)
    for _ in range(4000):
        text = "".join(rng.choices(PIECES, k=rng.randint(0, 12)))
        ids = own.whole.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == b"".join(i.to_bytes(4, "little") for i in ids), repr(text)


def test_long_words_take_little_memory(word_vocabulary):
    """A run of letters of any length is counted by offsets; as the library does it."""
    import tracemalloc

    own, rng = token_counts.counter(), random.Random(5)
    for size in (300, 5000, 60_000):
        word = "".join(rng.choices("abcdeinorst", k=size))
        assert own.chunk_counts(word).sum() == len(word_vocabulary.encode(word, add_special_tokens=False).ids)
    mixed = "été" * 3000 + "x" * 400 + "12" * 300 + " " + "日本" * 500
    assert own.chunk_counts(mixed).sum() == len(word_vocabulary.encode(mixed, add_special_tokens=False).ids)
    word = "".join(rng.choices("abcdeinorst", k=1_000_000))
    tracemalloc.start()
    own._count_word(word[:200_000])
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 30e6
    begun = time.time()
    assert own.chunk_counts(word).sum() > 200_000 and time.time() - begun < 60
    assert not any(len(w) > token_counts.LONG for w in own.words) and not any(len(w) > token_counts.LONG for w in own.states)
