"""Operator 7: token counts of whole texts; huge documents by overlapping chunks.

A text of more than chunk_chars is cut into chunks that overlap. The library encodes each chunk as it stands, with its
tokens' offsets and the pre-tokens that they belong to. Two neighbours are spliced at a stable common boundary: a place in
their overlap where both begin a pre-token, and around which both have `agree` pre-tokens with equal offsets and equal
ids on either side. Pre-tokens are found from left to right, and merges never leave one; so from a place that begins a
pre-token in both encodings on, both go on alike, and up to it the left one has seen enough of what follows. An overlap without
such a place is widened: it doubles until there is one, or until it reaches the end of the text, so that the rest is one
chunk. A text that is one huge word has no such place, and is encoded in one piece, as the library would.

Texts of up to chunk_chars go through the encoder's memo of white-space-free runs. Null texts count as empty (0 tokens, 0
bytes); rows are never merged, so repeated rows give repeated rows; other columns aren't read. An empty table gives an
empty result.
"""

from bisect import bisect_left
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame

from .common import map_batches
from .word_encoder import WordEncoder

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
#: start and end of a pre-token in the text, and its ids
PreToken = tuple[int, int, tuple[int, ...]]


def pre_tokens(encoding, base: int) -> list[PreToken]:
    """The pre-tokens of an Encoding of text[base:], with offsets in the text. Added tokens stand alone."""
    words = encoding.word_ids
    starts = [i for i, w in enumerate(words) if w is None or i == 0 or w != words[i - 1]]
    offsets, ids = encoding.offsets, encoding.ids
    return [(base + offsets[a][0], base + max(y for _, y in offsets[a:b]), tuple(ids[a:b])) for a, b in zip(starts, [*starts[1:], len(ids)])]


def common_boundary(left: list[PreToken], right: list[PreToken], agree: int) -> tuple[int, int] | None:
    """Places (i, j) such that left[i] and right[j] begin at a stable common boundary: the one nearest to the middle of those there are."""
    starts = [a for a, _, _ in right]
    found = []
    for i in range(bisect_left(left, (starts[0],)) if starts else len(left), len(left) - agree + 1):
        j = bisect_left(starts, left[i][0])
        if j >= agree and i >= agree and j + agree <= len(right) and left[i - agree : i + agree] == right[j - agree : j + agree]:
            found.append((i, j))
    return found[len(found) // 2] if found else None


def spliced(text: str, encode: Callable, chunk_chars: int, overlap: int, agree: int = 3) -> Iterator[list[PreToken]]:
    """The pre-tokens of the whole text, part after part; encode gives the Encoding of a piece of text."""
    size, start, stable = len(text), 0, 0  # left holds text[start:end], as it stands in the whole text from stable on

    def chunk(a: int, b: int) -> list[PreToken]:
        return pre_tokens(encode(text[a:b]), a)

    end = min(size, chunk_chars)
    left = chunk(0, end)
    while end < size:
        width, place = overlap, None
        while place is None and end - width > stable:
            cut = end - width
            further = min(size, cut + width + chunk_chars)
            right = chunk(cut, further)
            place = common_boundary(left, right, agree)
            width *= 2
        if place is None:  # not even an overlap of all that is stable has a boundary: the chunk itself grows
            end = min(size, 2 * end - start)
            left = [t for t in chunk(start, end) if t[0] >= stable]
            continue
        yield left[: place[0]]
        left, start, end = right[place[1] :], cut, further
        stable = left[0][0]
    yield left


def count_by_chunks(text: str, encode: Callable, chunk_chars: int, overlap: int) -> int:
    return sum(len(ids) for part in spliced(text, encode, chunk_chars, overlap) for _, _, ids in part)


def count_tokens(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", limit: int = 2048, chunk_chars: int = 65_536, overlap: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each row of docs (doc_id, text)."""

    def make():
        encoder = WordEncoder(tokenizer)
        encode = lambda text: encoder.full.encode(text, add_special_tokens=False)

        def apply(rows):
            texts = [t or "" for t in rows["text"]]
            n = [len(x) for x in encoder.ids([t if len(t) <= chunk_chars else "" for t in texts])]
            for i, t in enumerate(texts):
                if len(t) > chunk_chars:
                    n[i] = count_by_chunks(t, encode, chunk_chars, overlap)
            return {"doc_id": rows["doc_id"], "n_bytes": [len(t.encode()) for t in texts], "n_tokens": n, "over_limit": [x > limit for x in n]}

        return apply

    return map_batches(docs.select("doc_id", "text"), make, SCHEMA)
