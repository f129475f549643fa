"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. Every passage is encoded (shape of its words, marks, repetition,
hashed words), a hidden layer follows, and gated attention, tanh(V h) * sigmoid(U h), weighs the passages of a document;
the weighted sum gives the score. Only documents have labels; the weights of passages are learned from these.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import by_size, held_out, map_batches, sampled, texts_of

PASSAGE = 128
BUCKETS = 32
HIDDEN, ATTENTION = 24, 12
THRESHOLD = 0.7
#: labelled documents of each class to learn from, at most about; and passages of one of them, evenly spread
FIT_ROWS, FIT_PASSAGES = 2000, 32
PRIME = np.uint64(0x9E3779B97F4A7C15)

#: character groups that are counted in a passage, as bytes of UTF-8
GROUPS = (
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    b"0123456789",
    b".,;:?",
    b"!",
    b"#*$%&",
    b"|<>",
    b"\"'()[]{}/\\_=+-@~^`",
    bytes(range(128, 256)),
    b"\n",
)
FEATURES = len(GROUPS) + 7 + BUCKETS


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    group = np.full(256, len(GROUPS), np.uint8)
    for i, members in enumerate(GROUPS):
        group[list(members)] = i
    space = np.zeros(256, bool)
    space[list(b" \t\n\r\x0b\x0c")] = True
    return group, space


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2^64, and of its inverse."""
    inverse = np.uint64(pow(int(PRIME), -1, 1 << 64))
    one = np.ones(1, np.uint64)
    return tuple(np.cumprod(np.concatenate([one, np.full(n, p)])) for p in (PRIME, inverse))


def passages(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of the texts, and the text of each. A text without words is one passage of zeros."""
    group, space = _tables()
    parts = [b" " + t.encode() + b" " for t in texts]
    raw = np.frombuffer(b"".join(parts), np.uint8)
    begins = np.cumsum([0, *map(len, parts)])
    blank = space[raw]
    starts = np.flatnonzero(~blank[1:] & blank[:-1]) + 1
    ends = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1
    owner = np.searchsorted(begins, starts, "right") - 1
    words = np.bincount(owner, minlength=len(texts))
    nth = np.arange(len(starts)) - np.repeat(np.cumsum(words) - words, words)
    count = np.maximum(1, -(-words // PASSAGE))
    first = np.cumsum(count) - count
    passage = first[owner] + nth // PASSAGE
    total = int(count.sum())
    text_of = np.repeat(np.arange(len(texts)), count)
    out = np.zeros((total, FEATURES), np.float64)
    if not len(starts):
        return out, text_of
    opens = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]])
    filled = passage[opens]
    size = np.diff(np.r_[opens, len(starts)]).astype(np.float64)
    at = starts[opens]
    until = ends[np.r_[opens[1:], len(starts)] - 1]
    chars = np.maximum((until - at).astype(np.float64), 1)
    kinds = group[raw]
    for g in range(len(GROUPS)):
        seen = np.r_[0, np.cumsum(kinds == g)]
        out[filled, g] = (seen[until] - seen[at]) / chars
    power, inverse = _powers(1 << max(20, int(len(raw)).bit_length()))
    prefix = np.r_[np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: len(raw)])]
    word = (prefix[ends] - prefix[starts]) * inverse[starts] * PRIME
    length = (ends - starts).astype(np.float64)
    k = len(GROUPS)
    mean = np.add.reduceat(length, opens) / size
    out[filled, k] = mean / 10
    out[filled, k + 1] = np.sqrt(np.maximum(np.add.reduceat(length**2, opens) / size - mean**2, 0)) / 10
    order = np.lexsort((word, passage))
    fresh = np.r_[True, (word[order][1:] != word[order][:-1]) | (passage[order][1:] != passage[order][:-1])]
    out[filled, k + 2] = np.add.reduceat(fresh.astype(np.float64), opens) / size
    same = np.r_[False, (word[1:] == word[:-1]) & (passage[1:] == passage[:-1])]
    out[filled, k + 3] = np.add.reduceat(same.astype(np.float64), opens) / size
    pair = word * np.uint64(31) + np.r_[word[1:], word[:1]]
    order = np.lexsort((pair, passage))
    fresh = np.r_[True, (pair[order][1:] != pair[order][:-1]) | (passage[order][1:] != passage[order][:-1])]
    out[filled, k + 4] = np.add.reduceat(fresh.astype(np.float64), opens) / size
    last = kinds[ends - 1]
    out[filled, k + 5] = np.add.reduceat(((last >= 3) & (last <= 6)).astype(np.float64), opens) / size
    out[filled, k + 6] = np.log1p(size) / 5
    bucket = ((word >> np.uint64(40)) % np.uint64(BUCKETS)).astype(np.int64)
    hashed = np.bincount(passage * BUCKETS + bucket, minlength=total * BUCKETS).reshape(total, BUCKETS)
    out[:, k + 7 :] = hashed / np.maximum(hashed.sum(axis=1, keepdims=True), 1)
    return out, text_of


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    """Weights; ``mean`` and ``scale`` are of the features of the passages that it learned from."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    @property
    def tells_apart(self) -> bool:
        """Whether it learned from both classes; if not, every score is the same."""
        return bool(self.weights["c"].any())

    def forward(self, x: np.ndarray, bag: np.ndarray) -> dict[str, np.ndarray]:
        """Passages sorted by bag; every bag from 0 on has one."""
        w = self.weights
        first = np.flatnonzero(np.r_[True, bag[1:] != bag[:-1]])
        n = (x - self.mean) / self.scale
        h = np.tanh(n @ w["W"] + w["w"])
        t, s = np.tanh(h @ w["V"]), sigmoid(h @ w["U"])
        e = (t * s) @ w["a"]
        e = np.exp(e - np.maximum.reduceat(e, first)[bag])
        a = e / np.add.reduceat(e, first)[bag]
        z = np.add.reduceat(a[:, None] * h, first)
        return {"n": n, "h": h, "t": t, "s": s, "a": a, "z": z, "p": sigmoid(z @ w["c"] + w["b"])}

    def score(self, x: np.ndarray, bag: np.ndarray) -> np.ndarray:
        return self.forward(x, bag)["p"]


def train(x: np.ndarray, bag: np.ndarray, label: np.ndarray, epochs: int = 250, rate: float = 0.02, decay: float = 1e-3, seed: int = 11) -> Model:
    """Adam on the cross-entropy of all bags, whose order must not matter: ids in, ids out sorted by the caller."""
    rng = np.random.default_rng(seed)
    mean, scale = (x.mean(axis=0), x.std(axis=0) + 1e-3) if len(x) else (np.zeros(FEATURES), np.ones(FEATURES))
    shapes = {"W": (FEATURES, HIDDEN), "V": (HIDDEN, ATTENTION), "U": (HIDDEN, ATTENTION), "a": (ATTENTION,), "c": (HIDDEN,)}
    weights = {k: rng.normal(0, 1 / np.sqrt(s[0]), s) for k, s in shapes.items()} | {"w": np.zeros(HIDDEN), "b": np.zeros(())}
    model = Model(mean, scale, weights)
    if not len(label) or label.min() == label.max():  # nothing to tell apart: what is known is the one label, or nothing
        weights["c"][:] = 0
        weights["b"] = np.array(0.0 if not len(label) else 4.0 * (2 * label[0] - 1))
        return model
    first = np.flatnonzero(np.r_[True, bag[1:] != bag[:-1]])
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in weights.items()}
    for step in range(1, epochs + 1):
        f = model.forward(x, bag)
        d = (f["p"] - label) / len(label)
        grad = {"c": f["z"].T @ d, "b": d.sum()}
        dz = d[:, None] * weights["c"]
        da = (dz[bag] * f["h"]).sum(axis=1)
        de = f["a"] * (da - np.add.reduceat(f["a"] * da, first)[bag])
        gate = f["t"] * f["s"]
        grad["a"] = gate.T @ de
        dg = de[:, None] * weights["a"]
        dt, ds = dg * f["s"] * (1 - f["t"] ** 2), dg * f["t"] * f["s"] * (1 - f["s"])
        grad["V"], grad["U"] = f["h"].T @ dt, f["h"].T @ ds
        dh = f["a"][:, None] * dz[bag] + dt @ weights["V"].T + ds @ weights["U"].T
        dn = dh * (1 - f["h"] ** 2)
        grad["W"], grad["w"] = f["n"].T @ dn, dn.sum(axis=0)
        for k, g in grad.items():
            m, v = moment[k]
            g = g + decay * weights[k] * (k in shapes)
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            moment[k] = m, v
            weights[k] = weights[k] - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return model


def learn(docs: DataFrame, labels: DataFrame, per_class: int = FIT_ROWS, most_passages: int = FIT_PASSAGES) -> Model:
    """A model from labelled documents that are not held out.

    At most about ``per_class`` labelled documents of each class, those with the smallest hashes of id, and of each at most
    ``most_passages`` passages, evenly spread. Their features are computed on the executors and gathered: a few megabytes,
    whatever the corpus. Of several labels of a document the lowest counts; null labels and ids do not. Of several rows with
    one id the one with the lowest features counts, chosen before anything is gathered.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    chosen = sampled(known, "doc_id", per_class, "quality")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most about two times per_class ids

    def step(batch):
        ids, label, texts = batch.column(0).to_pylist(), batch.column(2).to_pylist(), texts_of(batch)
        for part in by_size(texts):
            x, owner = passages(texts[part])
            for i, (key, y) in enumerate(zip(ids[part], label[part], strict=True)):
                own = x[owner == i]
                if len(own) > most_passages:
                    own = own[np.linspace(0, len(own) - 1, most_passages).astype(int)]
                yield {"doc_id": [key], "quality": [y], "x": [own.astype(np.float32).tobytes()]}

    found = map_batches(rows.select("doc_id", "text", "quality"), step, "doc_id long, quality int, x binary")
    # one row of an id, however many rows have it
    found = found.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("x").alias("x")).toPandas().sort_values("doc_id")
    bags = [np.frombuffer(b, np.float32).reshape(-1, FEATURES) for b in found["x"]]
    x = np.concatenate(bags).astype(np.float64) if bags else np.zeros((0, FEATURES))
    bag = np.repeat(np.arange(len(bags)), [len(b) for b in bags]) if bags else np.zeros(0, np.int64)
    return train(x, bag, found["quality"].to_numpy(np.float64))


def score(docs: DataFrame, model: Model, *also: str, into: str = "score") -> DataFrame:
    """doc_id and the columns ``also`` of each row, score (0 to 1; named by ``into``). A null text counts as empty; an empty one is one passage of zeros."""
    kept = list(dict.fromkeys(["doc_id", *also]))

    def step(batch):
        at = batch.schema.get_field_index("text")
        texts = ["" if t is None else t for t in batch.column(at).to_pylist()]
        scores: list[float] = []
        for part in by_size(texts):
            scores += model.score(*passages(texts[part])).tolist()
        yield {n: batch.column(batch.schema.get_field_index(n)) for n in kept} | {into: scores}

    source = docs.select(*dict.fromkeys([*kept, "text"]))
    kinds = ", ".join(f"`{n}` {source.schema[n].dataType.simpleString()}" for n in kept)
    return map_batches(source, step, f"{kinds}, `{into}` double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from the threshold on) of every row."""
    scored = score(docs, learn(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
