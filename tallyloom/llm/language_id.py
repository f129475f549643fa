"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram is bound by multiplying its letters' vectors, each rotated by
its place; a text is the bundle (sum) of its trigrams' vectors, a language the bundle of its texts. The language whose
prototype has the largest cosine with a text is predicted.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.bpe import LETTER, classes
from tallyloom.llm.common import by_size, held_out, map_batches, texts_of

DIM = 512
#: letters with a vector: 26, those beyond share the others; 0 stands for whatever is no letter
SLOTS = 128
#: vectors of unit length are summed in whole numbers of this part, so that a sum is the same in any order
PARTS = 1 << 20
UNDETERMINED = "und"
#: a bound is this part of the low quantile of a language's own scores; texts of so many characters have 0.7 of a long one's score
LOW, OF_LOW, HALF_LENGTH = 0.01, 0.5, 320


def letter_vectors(dim: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (SLOTS, dim))


def slots() -> np.ndarray:
    code = np.arange(0x110000, dtype=np.int64)
    out = np.where(classes() == LETTER, 27 + (code * 2654435761 % (1 << 32)) % (SLOTS - 27), 0)
    out[ord("a") : ord("z") + 1] = np.arange(1, 27)
    return out.astype(np.uint8)


#: trigrams, texts, and pairs of both whose products are made at once
GRAMS, TEXTS, PAIRS = 4096, 512, 8192


class Encoder:
    """Texts to bundles."""

    def __init__(self, dim: int = DIM, seed: int = 7):
        self.dim, self.slots = dim, slots()
        letters = letter_vectors(dim, seed)
        self.placed = [np.roll(letters, 2 - k, axis=1) for k in range(3)]

    def bundles(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(texts, dim) sums of trigram vectors, and which texts have a letter. Runs of non-letters count as one."""
        lowered = [f" {t.lower()} " for t in texts]
        code = self.slots[np.frombuffer("".join(lowered).encode("utf-32-le"), np.uint32)]
        owner = np.repeat(np.arange(len(texts)), np.fromiter(map(len, lowered), np.int64, len(texts)))
        lettered = np.bincount(owner[code > 0], minlength=len(texts)) > 0
        keep = np.r_[True, (code[1:] > 0) | (code[:-1] > 0) | (owner[1:] != owner[:-1])] if len(code) else np.zeros(0, bool)
        code, owner = code[keep].astype(np.int64), owner[keep]
        inside = owner[2:] == owner[:-2]
        gram = ((code[:-2] * SLOTS + code[1:-1]) * SLOTS + code[2:])[inside]
        pairs, counts = np.unique(owner[2:][inside] * SLOTS**3 + gram, return_counts=True)
        text, gram = pairs // SLOTS**3, pairs % SLOTS**3
        grams, column = np.unique(gram, return_inverse=True)
        order = np.argsort(column, kind="stable")
        text, column, counts = text[order], column[order], counts[order]
        out = np.zeros((len(texts), self.dim), np.float32)
        for at in range(0, len(grams), GRAMS):  # some thousand trigrams at a time: large scripts have very many
            some = grams[at : at + GRAMS]
            bound = self.placed[0][some // SLOTS**2] * self.placed[1][some // SLOTS % SLOTS] * self.placed[2][some % SLOTS]
            here = slice(*np.searchsorted(column, (at, at + len(some))))
            rows, row = np.unique(text[here], return_inverse=True)  # texts that have any of them
            if 20 * len(row) < len(rows) * len(some):  # few of them in each text
                by_row = np.argsort(row, kind="stable")
                for first in range(0, len(by_row), PAIRS):
                    pair = by_row[first : first + PAIRS]
                    held, begin = np.unique(row[pair], return_index=True)
                    products = bound[column[here][pair] - at].astype(np.float32) * counts[here][pair, None]
                    out[rows[held]] += np.add.reduceat(products, begin)
                continue
            for first in range(0, len(rows), TEXTS):
                mine = (row >= first) & (row < first + TEXTS)
                dense = np.zeros((min(TEXTS, len(rows) - first), len(some)), np.float32)
                dense[row[mine] - first, column[here][mine] - at] = counts[here][mine]
                out[rows[first : first + TEXTS]] += dense @ bound.astype(np.float32)
        return out, lettered


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


@lru_cache(2)
def encoder(dim: int, seed: int) -> Encoder:
    """One encoder per worker process."""
    return Encoder(dim, seed)


@dataclass(frozen=True)
class Profiles:
    languages: tuple[str, ...]
    prototypes: np.ndarray
    dim: int
    seed: int


def known(docs: DataFrame) -> DataFrame:
    """doc_id, text, lang of the documents to learn from: all that are not held out and have a language."""
    return docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")


def learn(docs: DataFrame, dim: int = DIM, seed: int = 7) -> Profiles:
    """Prototypes from all documents of ``known``: sums that merge by adding. What the driver gets is one vector per language."""

    def sums(batch):
        texts, names = texts_of(batch), np.array(batch.column(1).to_pylist(), object)
        here, of = np.unique(names.astype(str), return_inverse=True)
        total = np.zeros((len(here), dim), np.int64)
        for part in by_size(texts):
            vectors, _ = encoder(dim, seed).bundles(texts[part])
            np.add.at(total, of[part], np.rint(unit(vectors) * PARTS).astype(np.int64))
        yield {"lang": here.tolist(), "v": total.tolist()}

    parts = map_batches(known(docs).select("text", "lang"), sums, "lang string, v array<long>")
    added = parts.select("lang", F.posexplode("v").alias("at", "x")).groupBy("lang", "at").agg(F.sum("x").alias("x"))
    whole = added.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("at", "x")))["x"].alias("v"))
    rows = whole.orderBy("lang").toPandas()
    prototypes = np.array([list(v) for v in rows["v"]], np.float64).reshape(len(rows), dim)
    return Profiles(tuple(rows["lang"]), unit(prototypes), dim, seed)


def predict(docs: DataFrame, profiles: Profiles, *also: str, into: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """doc_id, lang_pred, score (cosine, 0 where negative; names by ``into``) of each row, and the columns ``also`` as they are.

    A null text, one without a letter, and any text if no language was learned, is ``und`` with score 0. Of equal cosines
    the first language in order of name counts.
    """
    names = np.array([*profiles.languages, UNDETERMINED], object)

    def step(batch):
        texts = texts_of(batch)
        out_name, out_score = [], []
        for part in by_size(texts):
            vectors, lettered = encoder(profiles.dim, profiles.seed).bundles(texts[part])
            cosine = unit(vectors) @ profiles.prototypes.T if len(profiles.languages) else np.zeros((len(vectors), 1))
            best = cosine.argmax(axis=1)
            known = lettered & (len(profiles.languages) > 0)
            out_name += names[np.where(known, best, len(names) - 1)].tolist()
            out_score += np.where(known, np.clip(cosine[np.arange(len(best)), best], 0, 1), 0.0).tolist()
        yield {n: batch.column(batch.schema.get_field_index(n)) for n in kept} | {into[0]: out_name, into[1]: out_score}

    kept = list(dict.fromkeys(["doc_id", *also]))
    source = docs.select(*dict.fromkeys([*kept, "text"]))
    kinds = ", ".join(f"`{n}` {source.schema[n].dataType.simpleString()}" for n in kept)
    return map_batches(source, step, f"{kinds}, `{into[0]}` string, `{into[1]}` double")


def expected(length: Column | str) -> Column:
    """The share of a long text's cosine that a text of so many characters has, about."""
    n = F.col(length) if isinstance(length, str) else length
    return F.sqrt(n / (n + F.lit(float(HALF_LENGTH))))


def bounds(docs: DataFrame, profiles: Profiles) -> dict[str, float]:
    """Of each language the cosine, times ``expected``, below which a text isn't in it: a part of what nearly all of its own documents have.

    Scores of the documents of ``known`` are counted in buckets of a thousandth, per language predicted; such counts
    merge by adding. What the driver gets is one number per language.
    """
    scored = predict(known(docs), profiles, "lang", "text").where("lang_pred = lang")
    bucket = F.floor(1000 * F.col("score") / expected(F.greatest(F.length("text"), F.lit(1)))).alias("bucket")
    sketch = scored.select("lang", bucket).groupBy("lang", "bucket").agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy("lang")
    summed = sketch.withColumn("below", F.sum("n").over(by.orderBy("bucket"))).withColumn("total", F.sum("n").over(by))
    low = summed.where(F.col("below") >= LOW * F.col("total")).groupBy("lang").agg(F.min("bucket").alias("low"))
    return {r["lang"]: OF_LOW * r["low"] / 1000 for r in low.collect()}


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from the documents that are not held out, predicted for every row."""
    predicted = predict(docs, learn(docs))
    return predicted.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
