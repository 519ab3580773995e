"""Operator 3: N-best segmentation into SentencePiece pieces, and decoding.

The lattice has an edge for each piece of the model's vocabulary at each place of the text (spaces written as the
model's space mark, one put before the text), and byte pieces for characters that no piece covers. A segmentation's score
is the sum of its pieces' scores. Forward Viterbi gives each place the best score of reaching it, and the edge by which. That is an exact
heuristic for the search from the end: A-star orders hypotheses by suffix score plus heuristic, so complete ones come out in
the order of their scores.

As the heuristic is exact, a hypothesis that takes the best edge into its place loses nothing: it is followed to the start of the text
at once. Only an edge that isn't the best one makes a new hypothesis, with its loss, its place and a pointer to the hypothesis that
it leaves; ids are read off these pointers at the end. Of the hypotheses that wait no more are held than are still asked for.

No piece holds both a letter and another character after its leading spaces (checked when the model is read), so the
lattice of a text is a chain of segments. Each is read forward once, and its best way and the loss of its best other edge are kept in a
bounded memo. A segment whose loss isn't among the n - 1 smallest can't be left in one of the n best: the search follows its best way
without looking at its edges. Memory is in proportion to the text: a place holds a score and a back-pointer, edges are read from the vocabulary
when they are needed.

Null and empty texts have no pieces, one segmentation of score 0, and decode to the empty text. Ties go to the segmentation
that leaves the best one later in the text, then to the shorter last piece. Repeated rows come back once each; other columns aren't read. An
empty table gives an empty result.
"""

import heapq
import re
import zlib
from array import array

import numpy as np
from pyspark.sql import DataFrame

from .common import map_batches

SPACE = "▁"
BYTE_LOSS = 10.0  # below the least piece score
MEMO_CHARS = 64
DIGEST = "doc_id long, n_pieces long, best_score double, n_best int, nth_score double, ids_crc32 long, decoded boolean"
ROWS = "doc_id long, rank int, score double, ids array<long>"


def segments_pattern(pieces) -> re.Pattern:
    """Runs of letters, and of other characters, each with the spaces before it. Numerals such as superscripts, which \\w holds too, aren't letters."""
    numerals = "".join(re.escape(c) for c in sorted({c for p in pieces for c in p if c.isalnum() and not c.isalpha()}))
    return re.compile(rf" *[^\W\d_{numerals}]+| *(?:[\d_{numerals}]|[^\w ])+| +")



class Lattice:
    def __init__(self, name: str = "piece_bpe_32k.model", capacity: int = 400_000):
        import public_tokenizers
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
        self.pieces, self.bytes, self.text_of = {}, {}, {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[3:-1], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                text = piece.replace(SPACE, " ")
                self.pieces[text] = (i, model.get_score(i))
                self.text_of[i] = text.encode()
        self.pattern = segments_pattern(self.pieces)
        if crossing := [p for p in self.pieces if len(self.pattern.findall(p)) != 1]:
            raise ValueError(f"pieces cross the cuts of the lattice: {crossing[:5]}")
        self.text_of |= {i: bytes([b]) for b, i in self.bytes.items()}
        self.longest = max(map(len, self.pieces))
        #: by character: (what may follow, score and id if a piece ends here, else None)
        self.starts = self._tree()
        self.byte_score = min((s for _, s in self.pieces.values() if s > -1e8), default=0.0) - BYTE_LOSS
        self.capacity, self.memo, self.last = capacity, {}, []

    def _tree(self) -> dict[str, tuple]:
        """Pieces by their characters, one level a character. Longer pieces come first, so that a level is there when the piece that ends at it comes."""
        tree: dict[str, tuple] = {}
        for piece in sorted(self.pieces, key=len, reverse=True):
            level = tree
            for c in piece[:-1]:
                level = level.setdefault(c, ({}, None, None))[0]
            i, score = self.pieces[piece]
            level[piece[-1]] = (level.get(piece[-1], ({},))[0], score, i)
        return tree

    def raw(self, c: str) -> tuple[int, ...]:
        return tuple(self.bytes[x] for x in c.encode("utf-8", "surrogatepass"))

    def edges(self, text: str, b: int):
        """(start, score) of the edges into place b, shortest first."""
        if text[b - 1] not in self.pieces:
            yield b - 1, self.byte_score * len(self.raw(text[b - 1]))
        for a in range(b - 1, max(b - self.longest, 0) - 1, -1):
            if (found := self.pieces.get(text[a:b])) is not None:
                yield a, found[1]

    def ids_between(self, text: str, a: int, b: int) -> tuple[int, ...]:
        found = self.pieces.get(text[a:b])
        return (found[0],) if found else self.raw(text[a:b])

    def forward(self, text: str) -> tuple[array, array]:
        """Viterbi: the best score of reaching each place, and where the edge starts by which."""
        size, tree, longest = len(text), self.starts, self.longest
        best, by = array("d", [-np.inf]) * (size + 1), array("l", [0]) * (size + 1)
        best[0] = 0.0
        for a in range(size):
            here, level, b = best[a], tree, a
            for c in text[a : a + longest]:
                found = level.get(c)
                if found is None:  # no piece starts so
                    break
                b += 1
                level, score, _ = found
                if score is not None and here + score >= best[b]:  # of equal ones the last, which is the shortest
                    best[b], by[b] = here + score, a
            if text[a] not in self.pieces:
                score = here + self.byte_score * len(self.raw(text[a]))
                if score >= best[a + 1]:
                    best[a + 1], by[a + 1] = score, a
        return best, by

    def known(self, segment: str) -> tuple[float, bytes, float, bytes]:
        """Best score, its ids as bytes, the least loss of an edge that leaves the best way, and the text that the ids decode to."""
        found = self.memo.get(segment)
        if found is None:
            if len(segment) > MEMO_CHARS:
                best, by = self.forward(segment)
                loss = min((x for x, _, _ in self.departures(segment, best, by, len(segment))), default=np.inf)
                ids = self._ids(segment, by, {})
                return best[-1], ids, loss, b"".join(map(self.text_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))
            if len(self.memo) >= self.capacity:
                self.memo.clear()
            found = self.memo[segment] = self._of_short(segment)
        return found

    def _of_short(self, segment: str) -> tuple[float, bytes, float, bytes]:
        """As known says, with the best and the second best score of each place at hand."""
        size, tree = len(segment), self.starts
        best, second = [0.0] + [-np.inf] * size, [-np.inf] * (size + 1)
        by, piece = [0] * (size + 1), [None] * (size + 1)  # no piece: bytes
        for a in range(size):
            here, level, b = best[a], tree, a
            for c in segment[a:]:
                found = level.get(c)
                if found is None:  # no piece starts so
                    break
                b += 1
                level, score, i = found
                if score is not None:
                    score += here
                    if score >= best[b]:
                        second[b] = best[b]
                        best[b], by[b], piece[b] = score, a, i
                    elif score > second[b]:
                        second[b] = score
            if segment[a] not in self.pieces:
                b, score = a + 1, here + self.byte_score * len(self.raw(segment[a]))
                if score >= best[b]:
                    second[b] = best[b]
                    best[b], by[b], piece[b] = score, a, None
                elif score > second[b]:
                    second[b] = score
        place, ids, loss = size, [], np.inf
        while place:
            if best[place] - second[place] < loss:
                loss = best[place] - second[place]
            if piece[place] is None:
                ids.extend(reversed(self.raw(segment[by[place]])))
            else:
                ids.append(piece[place])
            place = by[place]
        ids.reverse()
        return best[-1], array("I", ids).tobytes(), loss, b"".join(map(self.text_of.__getitem__, ids))

    def _ids(self, segment: str, by, departed: dict[int, int]) -> bytes:
        """The ids of the way that takes the departed edges (start by place), and else the best ones."""
        ids, place = [], len(segment)
        while place:
            a = departed.get(place, by[place])
            ids.append(self.ids_between(segment, a, place))
            place = a
        return array("I", [i for own in reversed(ids) for i in own]).tobytes()

    def departures(self, segment: str, best: array, by: array, place: int):
        """(loss, place, start) of the edges that leave the best way back from place."""
        while place:
            top, way = best[place], by[place]
            for a, score in self.edges(segment, place):
                if a != way:
                    yield top - (best[a] + score), place, a
            place = way

    def nbest(self, text: str, n: int) -> list[tuple[float, list[tuple[int, bytes]]]]:
        """The n best of a whole text: score, and the (segment number, ids) that differ from the best. First comes the best, without any."""
        texts = self.pattern.findall(" " + text) if text else []
        get = self.memo.get
        segments = self.last = [get(s) or self.known(s) for s in texts]
        total = float(sum([s[0] for s in segments]))
        losses = np.array([s[2] for s in segments])
        near = np.flatnonzero(losses <= np.partition(losses, n - 2)[n - 2]) if 1 < n <= len(losses) else np.arange(len(losses))
        open_segments = sorted(sorted(near.tolist(), key=lambda k: (losses[k], -k))[: n - 1], reverse=True)
        lattices = {k: self.forward(texts[k]) for k in open_segments if segments[k][2] < np.inf}
        waiting: list[tuple] = [(0.0, 0, None, -1, 0, 0)]  # loss, number, the hypothesis that it leaves, segment, place, start
        out, made = [], 1
        while waiting and len(out) < n:
            hypothesis = heapq.heappop(waiting)
            loss, _, _, at, _, start = hypothesis
            out.append((total - loss, self._changes(texts, lattices, hypothesis)))
            for k in open_segments:  # from the end of the text to its start
                if k not in lattices or at >= 0 and k > at:
                    continue
                way = self.departures(texts[k], *lattices[k], start if k == at else len(texts[k]))
                for more, place, a in heapq.nsmallest(n - len(out), way, key=lambda x: x[0]):
                    heapq.heappush(waiting, (loss + more, made, hypothesis, k, place, a))
                    made += 1
            if len(waiting) > n - len(out):
                waiting = heapq.nsmallest(n - len(out), waiting)  # sorted, so still a heap
        return out

    def _changes(self, texts: list[str], lattices: dict, hypothesis) -> list[tuple[int, bytes]]:
        """The ids of the segments in which the hypothesis and those that it leaves depart from the best way."""
        edges: dict[int, dict[int, int]] = {}
        while hypothesis[2] is not None:
            _, _, left, k, place, a = hypothesis
            edges.setdefault(k, {})[place] = a
            hypothesis = left
        return [(k, self._ids(texts[k], lattices[k][1], own)) for k, own in edges.items()]

    def best_ids(self) -> bytes:
        """Of the text that nbest saw last."""
        return b"".join([s[1] for s in self.last])

    def best_text(self) -> str:
        """What best_ids decodes to; the bytes of characters may lie in several segments."""
        return b"".join([s[3] for s in self.last]).decode("utf-8", "replace")[1:]

    def ids_of(self, changes: list[tuple[int, bytes]]) -> list[int]:
        own = [s[1] for s in self.last]
        for k, ids in changes:
            own[k] = ids
        return np.frombuffer(b"".join(own), "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.text_of.__getitem__, ids)).decode("utf-8", "replace")[1:]


def encode(docs: DataFrame, n: int = 4, model: str = "piece_bpe_32k.model") -> DataFrame:
    """doc_id, rank, score and ids of the n best segmentations of each row of docs (doc_id, text)."""

    def make():
        lattice = Lattice(model)

        def apply(rows):
            out = {"doc_id": [], "rank": [], "score": [], "ids": []}
            for doc_id, text in zip(rows["doc_id"], rows["text"]):
                for rank, (score, changes) in enumerate(lattice.nbest(text or "", n), 1):
                    for column, value in zip(out.values(), (doc_id, rank, score, lattice.ids_of(changes))):
                        column.append(value)
            return out

        return apply

    return map_batches(docs.select("doc_id", "text"), make, ROWS)


def decode(encoded: DataFrame, model: str = "piece_bpe_32k.model") -> DataFrame:
    """The rows of encoded (doc_id, rank, ids) with their text."""

    def make():
        lattice = Lattice(model)
        return lambda rows: {"doc_id": rows["doc_id"], "rank": rows["rank"], "text": [lattice.decode(i or []) for i in rows["ids"]]}

    return map_batches(encoded.select("doc_id", "rank", "ids"), make, "doc_id long, rank int, text string")


def digest(docs: DataFrame, n: int = 4, model: str = "piece_bpe_32k.model") -> DataFrame:
    """For each row of docs: the best segmentation's pieces, score and checksum, how many of n there are, the last one's score, and whether the best decodes to the text."""

    def make():
        lattice = Lattice(model)

        def apply(rows):
            out = {x.split()[0]: [] for x in DIGEST.split(", ")}
            for doc_id, text in zip(rows["doc_id"], rows["text"]):
                found = lattice.nbest(text or "", n)
                ids = lattice.best_ids()
                same = lattice.best_text() == (text or "")
                for column, value in zip(out.values(), (doc_id, len(ids) // 4, found[0][0], len(found), found[-1][0], zlib.crc32(ids), same)):
                    column.append(value)
            return out

        return apply

    return map_batches(docs.select("doc_id", "text"), make, DIGEST)
