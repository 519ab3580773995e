"""Token ids of whole texts through the tokenizers library, with a bounded memo of white-space-free chunks.

word_bpe_49k.json drops white space before its merges, and its normalizers act on single characters or on a
character and the marks after it. So no token and no rule reaches over ASCII white space, and the ids of a text are
the ids of its chunks in order. Arrow splits many texts at once and numbers their distinct chunks; the library sees
those that the memo doesn't hold.
"""

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import one_thread

#: The characters by which byte-level vocabularies write the bytes 0 to 255.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_AS_CHAR = {b: b if b in _PLAIN else 256 + b - sum(x < b for x in _PLAIN) for b in range(256)}
_LATIN = 0x250


@lru_cache(maxsize=None)
def _library(name: str) -> tuple:
    """The library's tokenizer, and one of its model alone that splits at white space: once a process. Each new one that has encoded leaves
    several MB of the library's behind when it goes, so a worker that made them anew would grow with the number of its tasks."""
    import public_tokenizers
    from tokenizers import Tokenizer, pre_tokenizers

    full = Tokenizer.from_file(public_tokenizers.path(name))
    words = Tokenizer(full.model)
    words.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    return full, words


class WordEncoder:
    """capacity bounds the memo (two generations of half of it); batch_chars bounds what is split at once, beyond a single text."""

    def __init__(self, name: str = "word_bpe_49k.json", capacity: int = 300_000, batch_chars: int = 1_000_000):
        if not name.endswith(".json"):
            raise ValueError(f"{name}: only tokenizers that drop white space can be encoded by chunks")
        one_thread()
        self.full, self.words = _library(name)
        if self.full.encode(" \n ", add_special_tokens=False).ids:
            raise ValueError(f"{name} keeps white space")
        self.ends = np.zeros(self.full.get_vocab_size() + 1, bool)
        self.ends[[i for t, i in self.full.get_vocab().items() if t.endswith("</w>")]] = True
        self.half, self.batch_chars, self.memo, self.old = capacity // 2, batch_chars, {}, {}
        self.tails = {"": b"", ",": self._by_library([","])[0], ".": self._by_library(["."])[0]}

    def _by_library(self, chunks: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.full.encode_batch_fast(chunks, add_special_tokens=False)]

    @staticmethod
    def _lowered(text: str) -> str:
        """ASCII letters may be lowered here, which makes chunks repeat more, unless a special token could then match
        (those are found before the library lowers) or marks could then compose otherwise."""
        if "<|" in text:
            return text
        if text.isascii():
            return text.lower()
        if unicodedata.is_normalized("NFC", text) and unicodedata.is_normalized("NFC", text.lower()):
            return text.encode().lower().decode()
        return text

    @staticmethod
    def _single(chunk: str) -> str | None:
        """A chunk of Latin letters alone is one word, which the library's model can take without the steps before it."""
        if not chunk.isalpha():
            return None
        if chunk.isascii():
            return chunk.lower()
        if max(chunk) >= chr(_LATIN) or not unicodedata.is_normalized("NFC", chunk):
            return None
        word = chunk.lower()
        return word.encode().decode("latin-1").translate(_AS_CHAR) if word.isalpha() else None

    def _learn(self, chunks: list[str]) -> dict[str, bytes]:
        """The ids of all chunks (distinct), in their order. The memo gets the new ones afterwards, as far as it holds them."""
        found = dict(zip(chunks, map(self.memo.get, chunks)))
        new = [c for c, known in found.items() if known is None]
        for i in range(0, len(new), 2000):
            plain, rest = [], []
            for c in new[i : i + 2000]:
                if (known := self.old.get(c)) is not None:
                    found[c] = known
                    continue
                tail = c[-1:] if c[-1:] in (",", ".") else ""
                word = self._single(c[:-1] if tail else c)
                if word is None:
                    rest.append(c)
                else:
                    plain.append((c, word, tail))
            ids = np.array(self.words.encode(" ".join([w for _, w, _ in plain]), add_special_tokens=False).ids, "<u4")
            ends = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(ends) != len(plain):
                raise AssertionError("each word has one last token")
            raw = ids.tobytes()
            found.update({c: raw[a:b] + self.tails[tail] for (c, _, tail), a, b in zip(plain, [0, *ends], ends)})
            found.update(zip(rest, self._by_library(rest)))
        if len(self.memo) + len(new) > self.half:
            self.memo, self.old = {}, self.memo
        self.memo.update({c: found[c] for c in new[: self.half]})
        return found

    def _encode(self, texts: list[str]):
        split = pc.ascii_split_whitespace(pa.array([self._lowered(t) for t in texts], pa.large_string()))
        numbered = split.flatten().dictionary_encode()
        known = list(self._learn(numbered.dictionary.to_pylist()).values())
        flat = np.frombuffer(b"".join(known), "<u4")
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        starts = np.cumsum(sizes) - sizes
        at, bounds = numbered.indices.to_numpy(zero_copy_only=False), split.offsets.to_numpy()
        del known, numbered, split
        for a, b in zip(bounds, bounds[1:]):  # text after text, as ids and their places take several times the room of a text
            own = at[a:b]
            lengths = sizes[own]
            ends = np.cumsum(lengths)
            yield flat[np.repeat(starts[own] - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)]

    def ids(self, texts: list[str | None]):
        """One array of ids for each text, in order; a null text has none."""
        part, size = [], 0
        for t in texts:
            part.append(t or "")
            size += len(part[-1])
            if size >= self.batch_chars:
                yield from self._encode(part)
                part, size = [], 0
        if part:
            yield from self._encode(part)
