"""Operator 9: toxicity by bidirectional gated recurrent networks with attention pooling, over characters and words.

A character network reads each distinct word and pools its states; the word network reads, for each word, that vector, its
logit and a hashed word embedding, over windows of `window` words that overlap by half, and pools its states into a logit.
A document's score is a calibrated function of its highest window. Windows cover every word of the whole text.

Training, in numpy on the driver, sees a bounded sample of labelled rows: the fit_toxic and fit_clean labelled ids of
smallest hash, as far as they are among the rows to learn from, with texts of at most fit_chars characters (longer ones are
only scored). First the character network learns
words' odds of standing in toxic texts; then the word network learns from the windows that rank highest in each text
(a toxic text has a toxic window somewhere, a clean one has none); last, the highest windows are calibrated.

Null and empty texts, and texts without a letter, have no words and get score 0. With no labelled rows
of both kinds every score is 0. A doc_id with several labels counts as toxic if one of them is 1; of several texts
with one id, one is learned from. Repeated rows come back once each; other columns aren't read. An empty table gives an empty result.
"""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filter_rows, give_back, local_rows, map_batches, smallest_by_hash

CLASSES = 64  # of characters: none, a to z, and the others by remainder
LONGEST = 48  # characters that the character network reads at once
BUCKETS, EMBEDDED = 4096, 4
_LETTERS = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


class BiGRU:
    """Two gated recurrent networks, forward and backward in time, and attention over their states.

    Inputs are rows of a table of projections [n, 6 * hidden]: update, reset and candidate parts of both directions, by
    part. Both directions run at once: states are [batch, 2 * hidden], and the recurrent matrix has two blocks a part.
    """

    def __init__(self, hidden: int, rng):
        k = 2 * hidden
        self.k = k
        self.mask = np.tile(np.kron(np.eye(2), np.ones((hidden, hidden))), (1, 3)).astype(np.float32)
        self.p = {
            "recurrent": (rng.normal(0, 1 / np.sqrt(hidden), (k, 3 * k)) * self.mask).astype(np.float32),
            "attention": rng.normal(0, 0.1, k).astype(np.float32),
            "out": rng.normal(0, 0.3, k).astype(np.float32),
            "bias": np.zeros(1, np.float32),
        }

    def _inputs(self, table, ids, t):
        """Forward reads place t, backward the mirrored place."""
        h, k = self.k // 2, self.k
        x, y = table[ids[:, t]], table[ids[:, ids.shape[1] - 1 - t]]
        x = x.copy()
        for part in range(3):
            x[:, part * k + h : (part + 1) * k] = y[:, part * k + h : (part + 1) * k]
        return x

    def forward(self, table, ids, keep=False):
        """logit [batch], pooled states [batch, 2 * hidden]; keep: what backward needs."""
        n, steps = ids.shape
        k, h2 = self.k, self.k // 2
        state = np.zeros((n, k), np.float32)
        states = np.empty((steps, n, k), np.float32)
        kept = []
        for t in range(steps):
            x = self._inputs(table, ids, t)
            g = state @ self.p["recurrent"]
            gates = _sigmoid(x[:, : 2 * k] + g[:, : 2 * k])
            z, r = gates[:, :k], gates[:, k:]
            c = np.tanh(x[:, 2 * k :] + r * g[:, 2 * k :])
            new = c + z * (state - c)
            if keep:
                kept.append((state, z, r, c, g[:, 2 * k :]))
            state = new
            states[t, :, :h2] = state[:, :h2]
            states[steps - 1 - t, :, h2:] = state[:, h2:]
        e = states @ self.p["attention"]
        w = np.exp(e - e.max(0))
        w /= w.sum(0)
        pooled = np.einsum("tn,tnk->nk", w, states)
        logit = pooled @ self.p["out"] + self.p["bias"][0]
        return logit, pooled, (states, w, pooled, kept) if keep else None

    def backward(self, ids, d_logit, cache):
        """Gradients of the parameters, and of the input rows [steps, batch, 6 * hidden] by place."""
        states, w, pooled, kept = cache
        steps, n, k = states.shape
        h2 = k // 2
        grads = {"out": pooled.T @ d_logit, "bias": d_logit.sum(keepdims=True)}
        d_pooled = d_logit[:, None] * self.p["out"]
        d_w = np.einsum("nk,tnk->tn", d_pooled, states)
        d_e = w * (d_w - (w * d_w).sum(0))
        grads["attention"] = np.einsum("tn,tnk->k", d_e, states)
        d_states = w[:, :, None] * d_pooled + d_e[:, :, None] * self.p["attention"]
        d_inputs = np.empty((steps, n, 3 * k), np.float32)
        d_recurrent = np.zeros_like(self.p["recurrent"])
        d_next = np.zeros((n, k), np.float32)
        for t in range(steps - 1, -1, -1):
            state, z, r, c, gc = kept[t]
            d = d_next.copy()
            d[:, :h2] += d_states[t, :, :h2]
            d[:, h2:] += d_states[steps - 1 - t, :, h2:]
            d_c = d * (1 - z) * (1 - c * c)
            d_z = d * (state - c) * z * (1 - z)
            d_r = d_c * gc * r * (1 - r)
            d_x = np.concatenate([d_z, d_r, d_c], 1)
            d_g = np.concatenate([d_z, d_r, d_c * r], 1)
            d_recurrent += state.T @ d_g
            d_next = d * z + d_g @ self.p["recurrent"].T
            mirrored = steps - 1 - t
            for part in range(3):
                d_inputs[t, :, part * k : part * k + h2] = d_x[:, part * k : part * k + h2]
                d_inputs[mirrored, :, part * k + h2 : (part + 1) * k] = d_x[:, part * k + h2 : (part + 1) * k]
        grads["recurrent"] = d_recurrent * self.mask
        return grads, d_inputs


class Adam:
    def __init__(self, rate: float):
        self.rate, self.t, self.m, self.v = rate, 0, {}, {}

    def step(self, params: dict, grads: dict) -> None:
        self.t += 1
        for k, g in grads.items():
            m = self.m[k] = 0.9 * self.m.get(k, 0) + 0.1 * g
            v = self.v[k] = 0.999 * self.v.get(k, 0) + 0.001 * g * g
            params[k] -= (self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)).astype(np.float32)


def split_words(texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct words (runs of letters, lowered), their numbers in the order of the texts, and each text's bounds."""
    import pyarrow as pa
    import pyarrow.compute as pc

    plain = [(t or "").lower().encode().translate(_LETTERS).strip() for t in texts]
    parts = pc.ascii_split_whitespace(pa.array(plain, pa.large_binary()).cast(pa.large_string()))
    flat = parts.flatten().dictionary_encode()
    distinct = flat.dictionary.to_pylist()
    at = flat.indices.to_numpy(zero_copy_only=False)
    bounds = parts.offsets.to_numpy()
    if "" in distinct:  # what splitting makes of an empty text
        filled = np.array([w != "" for w in distinct])[at]
        bounds = np.concatenate([[0], np.cumsum(filled)])[bounds]
        at = at[filled]
    return distinct, at.astype(np.int64), bounds


def in_parts(texts: list[str | None], batch_chars: int):
    """Texts in order, in lists that end where they reach batch_chars characters, so that what is made of one doesn't grow with the number of texts."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t or "")
        if size >= batch_chars:
            yield part
            part, size = [], 0
    if part:
        yield part


def char_classes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all characters of the words, and the words' lengths."""
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return np.where((points >= 97) & (points <= 122), points - 96, 27 + points % (CLASSES - 27)), np.fromiter(map(len, words), np.int64, len(words))


def word_buckets(words: list[str]) -> np.ndarray:
    from zlib import crc32

    return np.fromiter((crc32(w.encode("utf-8", "surrogatepass")) % BUCKETS for w in words), np.int64, len(words))


class Model:
    def __init__(self, hidden: int, window: int, seed: int):
        rng = np.random.default_rng(seed)
        self.window, self.rng = window, rng
        self.chars, self.words = BiGRU(hidden, rng), BiGRU(hidden, rng)
        self.letters = rng.normal(0, 0.5, (CLASSES, 6 * hidden)).astype(np.float32)
        self.embedding = np.zeros((BUCKETS, EMBEDDED), np.float32)
        self.project = rng.normal(0, 0.2, (2 * hidden + 1 + EMBEDDED, 6 * hidden)).astype(np.float32)
        self.shift = np.zeros(6 * hidden, np.float32)
        self.slope, self.level = 1.0, 0.0

    def word_vectors(self, words: list[str], batch: int = 8192) -> np.ndarray:
        """Pooled states of the character network and its logit, for each word."""
        classes, sizes = char_classes(words)
        starts = np.cumsum(sizes) - sizes
        out = np.zeros((len(words), self.chars.k + 1), np.float32)
        for size in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == size)
            if not size:
                continue
            pieces = range(0, 1) if size <= LONGEST else [*range(0, size - LONGEST, LONGEST // 2), size - LONGEST]
            for i in range(0, len(own), batch):
                part = own[i : i + batch]
                best = None
                for piece in pieces:  # of an overlong word, the piece of highest logit
                    ids = classes[starts[part][:, None] + piece + np.arange(min(size, LONGEST))]
                    logit, pooled, _ = self.chars.forward(self.letters, ids)
                    got = np.concatenate([pooled, logit[:, None]], 1)
                    best = got if best is None else np.where((got[:, -1] > best[:, -1])[:, None], got, best)
                out[part] = best
        return out

    def table(self, vectors: np.ndarray, buckets: np.ndarray) -> np.ndarray:
        """The word network's inputs by word; the last row pads short texts."""
        rows = np.concatenate([vectors, self.embedding[buckets]], 1) @ self.project + self.shift
        return np.concatenate([rows, np.zeros((1, rows.shape[1]), np.float32)])

    def windows(self, n_words: int) -> np.ndarray:
        """Starts of overlapping windows that cover n_words; the last ends with the text."""
        if n_words <= self.window:
            return np.zeros(1, np.int64)
        return np.append(np.arange(0, n_words - self.window, self.window // 2), n_words - self.window)

    def window_ids(self, at: np.ndarray, pad: int) -> np.ndarray:
        if len(at) < self.window:
            at = np.concatenate([at, np.full(self.window - len(at), pad)])
        return at[self.windows(len(at))[:, None] + np.arange(self.window)]

    def logits(self, texts: list[str | None], batch: int = 4096) -> np.ndarray:
        """The highest window's logit of each text; of a text without words, minus infinity."""
        words, at, bounds = split_words(texts)
        table = self.table(self.word_vectors(words), word_buckets(words)) if words else np.zeros((1, self.shift.size), np.float32)
        pad = len(table) - 1
        out = np.full(len(texts), -np.inf, np.float32)
        todo, owners, size = [], [], 0
        for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
            todo.append(self.window_ids(at[a:b], pad))
            owners.append(np.full(len(todo[-1]), i))
            size += len(todo[-1])
            if size >= batch or i == len(texts) - 1:
                ids, own = np.concatenate(todo), np.concatenate(owners)
                for j in range(0, len(ids), batch):
                    np.maximum.at(out, own[j : j + batch], self.words.forward(table, ids[j : j + batch])[0])
                todo, owners, size = [], [], 0
        out[np.diff(bounds) == 0] = -np.inf
        return out

    def scores(self, texts: list[str | None], batch_chars: int = 1_000_000) -> list[float]:
        out = []
        for part in in_parts(texts, batch_chars):
            logits = self.logits(part).astype(float)
            known = np.isfinite(logits)
            out += np.where(known, 1 / (1 + np.exp(-np.clip(self.slope * np.where(known, logits, 0) + self.level, -50, 50))), 0.0).tolist()
        return out

    # Training

    def fit(self, texts: list[str], toxic: np.ndarray, char_steps: int, word_epochs: int, batch_chars: int = 1_000_000) -> None:
        numbers, docs = {}, []
        for part in in_parts(texts, batch_chars):
            distinct, at, bounds = split_words(part)
            at = np.fromiter((numbers.setdefault(w, len(numbers)) for w in distinct), np.int64, len(distinct))[at]
            docs += [at[a:b] for a, b in zip(bounds, bounds[1:])]
        words = list(numbers)
        self._fit_chars(words, docs, toxic, char_steps)
        vectors, buckets = self.word_vectors(words), word_buckets(words)
        self._fit_words(vectors, buckets, docs, toxic, word_epochs)
        self._calibrate(np.concatenate([self.logits(part) for part in in_parts(texts, batch_chars)]).astype(float), toxic)

    def _fit_chars(self, words, docs, toxic, steps, batch=256):
        n = np.zeros((2, len(words)))
        for own, y in zip(docs, toxic):
            n[int(y), np.unique(own)] += 1
        rate = n / np.array([[max((toxic == 0).sum(), 1)], [max((toxic == 1).sum(), 1)]])
        target = rate[1] / np.maximum(rate.sum(0), 1e-12)
        sizes = np.fromiter(map(len, words), int, len(words))
        usable = (sizes > 0) & (sizes <= LONGEST)
        high = np.flatnonzero(usable & (n[1] >= 2) & (target > 0.9))
        low = np.flatnonzero(usable & (target < 0.7))
        if not len(high) or not len(low):
            return
        classes, lengths = char_classes(words)
        starts = np.cumsum(lengths) - lengths
        weight = np.zeros(len(words))
        for part, own in ((high, n[1][high] ** 1.5), (low, np.log1p(n[0][low]))):
            weight[part] = own / own.sum()
        sizes = np.unique(lengths[np.concatenate([high, low])])  # each step takes words of one length, so nothing is padded
        groups = [(high[lengths[high] == size], low[lengths[low] == size]) for size in sizes]
        mass = np.array([[weight[part].sum() for part in g] for g in groups])
        adam = Adam(0.01)
        params = {"letters": self.letters} | self.chars.p
        for step, at in enumerate(self.rng.choice(len(groups), steps, p=mass.sum(1) / mass.sum())):
            adam.rate = 0.01 * (1 - step / steps) + 0.0005
            size, n_high = sizes[at], round(batch * mass[at, 0] / mass[at].sum())
            chosen = np.concatenate([self.rng.choice(part, k, p=weight[part] / weight[part].sum()) for part, k in zip(groups[at], (n_high, batch - n_high)) if k])
            y = np.repeat([1.0, 0.0], [n_high, batch - n_high])
            ids = classes[starts[chosen][:, None] + np.arange(size)]
            logit, _, cache = self.chars.forward(self.letters, ids, keep=True)
            grads, d_in = self.chars.backward(ids, ((_sigmoid(logit) - y) / batch).astype(np.float32), cache)
            onehot = np.eye(CLASSES, dtype=np.float32)[ids.T.reshape(-1)]
            grads["letters"] = onehot.T @ d_in.reshape(-1, d_in.shape[-1])
            adam.step(params, grads)

    def _fit_words(self, vectors, buckets, docs, toxic, epochs, batch=128):
        pad = len(vectors)
        vectors = np.concatenate([vectors, np.zeros((1, vectors.shape[1]), np.float32)])
        buckets = np.append(buckets, 0)
        peaks = np.append(vectors[:-1, -1], -np.inf)
        ids, labels = [], []
        for own, y in zip(docs, toxic):
            w = self.window_ids(own, pad)
            order = np.argsort(-np.sort(peaks[w], 1)[:, -1], kind="stable")
            chosen = order[:1] if y else np.unique([order[0], self.rng.integers(len(w)), self.rng.integers(len(w))])
            ids.append(w[chosen])
            labels.append(np.full(len(chosen), float(y)))
        ids, labels = np.concatenate(ids), np.concatenate(labels)
        adam = Adam(0.005)
        params = {"project": self.project, "shift": self.shift, "embedding": self.embedding} | self.words.p
        weight = np.where(labels > 0, (labels == 0).sum() / max((labels > 0).sum(), 1), 1.0) ** 0.5
        for _ in range(epochs):
            order = self.rng.permutation(len(ids))
            for i in range(0, len(order), batch):
                part = order[i : i + batch]
                w = ids[part]
                distinct, back = np.unique(w, return_inverse=True)
                back = back.reshape(w.shape)
                features = np.concatenate([vectors[distinct], self.embedding[buckets[distinct]]], 1)
                real = (distinct != pad)[:, None].astype(np.float32)
                table = (features @ self.project + self.shift) * real
                logit, _, cache = self.words.forward(table, back, keep=True)
                d = ((_sigmoid(logit) - labels[part]) * weight[part] / len(part)).astype(np.float32)
                g, d_in = self.words.backward(back, d, cache)
                d_table = np.zeros_like(table)
                np.add.at(d_table, back.T.reshape(-1), d_in.reshape(-1, d_in.shape[-1]))
                d_table *= real
                g["project"], g["shift"] = features.T @ d_table, d_table.sum(0)
                d_embedding = np.zeros_like(self.embedding)
                np.add.at(d_embedding, buckets[distinct], (d_table @ self.project.T)[:, -EMBEDDED:])
                g["embedding"] = d_embedding
                adam.step(params, g)

    def _calibrate(self, logit, toxic):
        """Logistic regression on the highest windows, by Newton's method, after scaling; with a small penalty on the slope."""
        logit, toxic = logit[np.isfinite(logit)], toxic[np.isfinite(logit)]
        if not len(logit):
            return
        mean, spread = logit.mean(), max(logit.std(), 1e-6)
        x = np.stack([(logit - mean) / spread, np.ones(len(logit))], 1)
        w = np.zeros(2)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            g = x.T @ (p - toxic) + np.array([0.1 * w[0], 0])
            h = (x * (p * (1 - p))[:, None]).T @ x + np.diag([0.1, 1e-3])
            w -= np.linalg.solve(h, g)
        self.slope, self.level = float(max(w[0], 0) / spread), float(w[1] - max(w[0], 0) * mean / spread)


def labelled_sample(docs: DataFrame, labels: DataFrame, fit_toxic: int, fit_clean: int, fit_chars: int) -> list:
    """(text, toxic) of at most fit_toxic and fit_clean ids, one text each. Ids are chosen among the labels alone, by hash; of docs only their rows
    leave their tasks, so no text is shuffled to find the sample. labels: doc_id, toxic."""
    marked = labels.filter("toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic")).filter("doc_id is not null")
    n = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    ids = [(r["doc_id"], r["toxic"]) for kind, most in ((True, fit_toxic), (False, fit_clean)) for r in smallest_by_hash(marked.filter(F.col("toxic") == kind), ["doc_id"], most, n.get(kind, 0))]
    chosen = local_rows(docs.sparkSession, ids, "doc_id long, toxic boolean")  # fit_toxic + fit_clean rows at most
    known = docs.filter(F.length("text") <= fit_chars).select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return known.groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("first")).select("first.text", "toxic").orderBy(F.desc("toxic"), F.xxhash64("doc_id")).collect()


def train(docs: DataFrame, labels: DataFrame, fit_toxic: int, fit_clean: int, fit_chars: int, hidden: int, window: int, char_steps: int, word_epochs: int, seed: int) -> Model | None:
    """A model, or None without labelled rows of both kinds. What the sample and the training took of the driver's memory goes back to the system."""
    sample = labelled_sample(docs, labels, fit_toxic, fit_clean, fit_chars)
    texts, toxic = [r["text"] for r in sample], np.array([float(r["toxic"]) for r in sample])
    model = Model(hidden, window, seed) if 0 < toxic.sum() < len(toxic) else None
    if model:
        model.fit(texts, toxic, char_steps, word_epochs)
    sample = texts = None
    give_back()
    return model


PARAMETERS = {"fit_toxic": 1500, "fit_clean": 4500, "fit_chars": 20_000, "hidden": 8, "window": 32, "char_steps": 1500, "word_epochs": 6, "seed": 5}


def score_toxicity(docs: DataFrame, training: DataFrame, labels: DataFrame, cut: float = 0.7, **parameters: int) -> DataFrame:
    """doc_id, score and predicted for each row of docs (doc_id, text); learned from the rows of training (doc_id, text) that labels (doc_id, toxic) mark."""
    model = docs.sparkSession.sparkContext.broadcast(train(training, labels, **PARAMETERS | parameters))

    def make():
        def apply(rows):
            scores = scores_of(model.value, rows["text"])
            return {"doc_id": rows["doc_id"], "score": scores, "predicted": [int(s >= cut) for s in scores]}

        return apply

    return map_batches(docs.select("doc_id", "text"), make, "doc_id long, score double, predicted int")


def clean_rows(docs: DataFrame, training: DataFrame, labels: DataFrame, cut: float = 0.7, **parameters: int) -> DataFrame:
    """The rows of docs that score_toxicity doesn't call toxic, with all their columns. Each row is judged where it lies: none is shuffled."""
    model = docs.sparkSession.sparkContext.broadcast(train(training, labels, **PARAMETERS | parameters))
    return filter_rows(docs, "text", lambda: lambda texts: np.array(scores_of(model.value, texts.to_pylist())) < cut)


def scores_of(model: Model | None, texts: list[str | None]) -> list[float]:
    return model.scores(texts) if model else [0.0] * len(texts)
