"""Operator 7: splicing overlapping chunks against encoding whole texts, with two tokenizers."""

import random

import public_tokenizers
import pytest
from logweave.llm import token_count
from logweave.llm.word_encoder import WordEncoder
from tokenizers import Tokenizer

TEXTS = {
    "words": "Hello, wörld! it's 1234 things\n\n  and more. " * 400,
    "one word": "long" * 2000,
    "one word in words": "some words here and there " * 50 + "x" * 3000 + " and some words after that one " * 50,
    "digits": "".join(random.Random(1).choice("0123456789") for _ in range(4000)),
    "specials": "a <|endoftext|>b <|startoftext|> " * 200,
    "marks": "e\u0301a\u0308 cafe\u0301  \u3000日本語のテキスト。 " * 200,
    "spaces": "  \n\t " * 900 + "a" + " " * 3000 + "b",
    "empty": "",
}


def tokenizer(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return t, lambda text: t.encode(text, add_special_tokens=False)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@pytest.mark.parametrize("kind", TEXTS)
def test_spliced_ids_equal_whole_ids(name, kind):
    _, encode = tokenizer(name)
    for chunk, overlap in ((200, 10), (333, 64), (64, 4)):
        parts = token_count.spliced(TEXTS[kind], encode, chunk, overlap)
        assert [i for part in parts for _, _, ids in part for i in ids] == encode(TEXTS[kind]).ids


def test_random_texts():
    r = random.Random(2)
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        _, encode = tokenizer(name)
        for _ in range(150):
            text = "".join(r.choice(["a", "bc", " ", "  ", "\n", "1", "23", "é", "e\u0301", "ß", "'s", "'", "<|endoftext|>", ".", "!!", "日本", "😀", "Ab"]) for _ in range(r.randrange(600)))
            parts = token_count.spliced(text, encode, 80, 8)
            assert [i for part in parts for _, _, ids in part for i in ids] == encode(text).ids


def test_overlaps_widen_where_alignment_fails():
    """In a byte-level vocabulary a run of letters is one pre-token: chunks that begin in it split it otherwise than the whole does."""
    _, encode = tokenizer("byte_bpe_50k.json")
    text = ("abcdefghij" * 30 + " ") * 30
    asked = []

    def counted(piece):
        asked.append(len(piece))
        return encode(piece)

    assert token_count.count_by_chunks(text, counted, 2000, 16) == len(encode(text).ids)
    assert max(asked) > 2000 + 16 and len(asked) > len(text) // 2000 + 1  # more and longer chunks than without failures
    asked.clear()
    plain = "a few short words " * 500
    assert token_count.count_by_chunks(plain, counted, 2000, 64) == len(encode(plain).ids) and max(asked) <= 2000 + 64


def test_chunks_of_a_long_text_are_short():
    _, encode = tokenizer("word_bpe_49k.json")
    text, asked = "Words, of a text that is much longer than its chunks. " * 20_000, []
    n = token_count.count_by_chunks(text, lambda t: asked.append(len(t)) or encode(t), 65_536, 512)
    assert n == sum(map(len, WordEncoder().ids([text]))) and max(asked) <= 65_536 + 512


def test_a_tokenizer_that_keeps_white_space_is_refused():
    with pytest.raises(ValueError, match="white space"):
        WordEncoder("byte_bpe_50k.json")


def test_encoders_of_one_process_share_what_the_library_holds():
    from logweave.llm.word_encoder import WordEncoder

    a, b = WordEncoder(), WordEncoder(capacity=16)
    assert a.full is b.full and a.words is b.words
    assert a.memo is not b.memo and [x.tolist() for x in a.ids(["some words", None])] == [x.tolist() for x in b.ids(["some words", None])]
