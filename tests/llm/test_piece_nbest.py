"""Operator 3: the n best against enumerating every segmentation; decoding against the library; long runs of letters."""

import random
import resource
import time

import public_tokenizers
import pytest
import sentencepiece
from logweave.llm import piece_nbest


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def lattice():
    return piece_nbest.Lattice()


def every_segmentation(model, lattice, text):
    """(score, ids) of all, from the library's own list of pieces."""
    pieces = {}
    for i in range(model.get_piece_size()):
        if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            pieces[model.id_to_piece(i)] = (i, model.get_score(i))
    text = ("▁" + text.replace(" ", "▁")) if text else ""
    ways = {len(text): [(0.0, ())]}
    for a in range(len(text) - 1, -1, -1):
        ways[a] = []
        for b in range(a + 1, len(text) + 1):
            if text[a:b] in pieces:
                i, s = pieces[text[a:b]]
                ways[a] += [(s + r, (i, *rest)) for r, rest in ways[b]]
        if text[a] not in pieces:
            raw = [model.piece_to_id(f"<0x{x:02X}>") for x in text[a].encode()]
            ways[a] += [(lattice.byte_score * len(raw) + r, (*raw, *rest)) for r, rest in ways[a + 1]]
    return sorted(ways[0], key=lambda x: -x[0])


@pytest.mark.parametrize("n", [1, 2, 6, 40])
def test_n_best_equal_enumeration(model, lattice, n):
    r = random.Random(n)
    texts = ["hello world", "an apple", "a1b, c", "日本 x", "naïve", "aaaa", "  a  b ", "", "☃", "x☃☃y", "aa aa", "12,34"] + ["".join(r.choice("abeht 1,é") for _ in range(9)) for _ in range(12)]
    for text in texts:
        expected = every_segmentation(model, lattice, text)
        found = [(s, tuple(lattice.ids_of(changes))) for s, changes in lattice.nbest(text, n)]
        assert [s for s, _ in found] == pytest.approx([s for s, _ in expected[:n]])
        assert len(set(found)) == len(found) == min(n, len(expected))
        scores = {ids: s for s, ids in expected}
        assert all(scores[ids] == pytest.approx(s) for s, ids in found)
        least = found[-1][0]
        assert {ids for s, ids in expected if s > least + 1e-6} <= {ids for _, ids in found}  # all that are better than the last


def test_decoding_equals_the_library(model, lattice):
    for text in ("Hello, World! 123", "été — straße", "日本語 ☃ 😀", "a  b", "x\ny\tz", ""):
        for _, changes in lattice.nbest(text, 5):
            ids = lattice.ids_of(changes)
            assert lattice.decode(ids) == text == model.decode(ids)


class Counted(str):
    """Counts the parts that are cut out of it."""

    cuts = 0

    def __getitem__(self, at):
        Counted.cuts += isinstance(at, slice)
        return str.__getitem__(self, at)


def test_a_segment_is_read_by_its_characters_and_decoded_once(lattice):
    words = [" international", " straightforwardness", " 12345", "naïvely", " x☃", " "]
    Counted.cuts = 0
    for word in words:
        score, ids, loss, raw = lattice._of_short(Counted(word))
        best, by = lattice.forward(word)
        losses = [x for x, _, _ in lattice.departures(word, best, by, len(word))]
        assert (score, ids, loss, raw.decode()) == (best[-1], lattice._ids(word, by, {}), min(losses, default=float("inf")), word)
    assert Counted.cuts <= 2 * sum(map(len, words))
    for text in ("".join(words), "日本語 ☃ 😀☃", ""):
        lattice.nbest(text, 3)
        assert lattice.best_text() == text


@pytest.mark.parametrize("text", ["a" * 1_000_000, "".join(random.Random(1).choice("etaoinshrdlu") for _ in range(1_000_000)), "☃" * 200_000, " " * 300_000, "ab, " * 200_000], ids=["equal", "letters", "bytes", "spaces", "words"])
def test_a_million_letters_in_bounded_memory(lattice, text):
    before, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.process_time()
    found = lattice.nbest(text, 4)
    assert lattice.decode(lattice.ids_of(found[-1][1])) == text and len(found) == (1 if text[0] == "☃" else 4)
    assert (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024 < 500 and time.process_time() - began < 120
