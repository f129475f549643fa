"""Token counts of the sections of a text, from one encoding of the whole text.

Encoding each section on its own would give other tokens at its edges. Here the whole text is encoded once; the tokens'
character spans and the sections' spans are both sorted, so the interval join of a text is a binary search.

Sections are the maximal stretches between line feeds, each with its line feed, so that they cover the text. Rule for a
token that crosses a boundary: it counts for the section that holds the first character it touches, and is reported as
``n_crossing`` there; ``n_shared`` of a section counts tokens that begin before it and reach into it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame

from tallyloom.llm.bpe import load
from tallyloom.llm.common import map_batches, texts_of

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: from a text to the starts of its sections, the first of them 0
Sections = Callable[[str], np.ndarray]


def lines(text: str) -> np.ndarray:
    """Starts of the lines; the line feed belongs to the line it ends."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    feeds = np.flatnonzero(codes == 10) + 1
    return np.r_[0, feeds[feeds < len(codes)]]


def token_spans(text: str, ids: np.ndarray, token_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Character spans of byte-level tokens: every character of which a token holds a byte is in its span."""
    size = token_bytes[ids]
    ends = np.cumsum(size)
    if len(text) == (ends[-1] if len(ends) else 0):
        return ends - size, ends
    raw = np.frombuffer(text.encode(), np.uint8)
    char = np.cumsum((raw & 0xC0) != 0x80) - 1
    return char[ends - size], char[ends - 1] + 1


def attribute(starts: np.ndarray, ends: np.ndarray, sections: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per section: tokens that begin in it, those of them that reach beyond it, and tokens that reach into it."""
    n = len(sections)
    owner = np.searchsorted(sections, starts, "right") - 1
    last = np.searchsorted(sections, ends - 1, "right") - 1
    crossing = last > owner
    shared = np.zeros(n + 1, np.int64)
    np.add.at(shared, owner[crossing] + 1, 1)
    np.add.at(shared, last[crossing] + 1, -1)
    return np.bincount(owner, minlength=n), np.bincount(owner[crossing], minlength=n), np.cumsum(shared)[:n]


def section_tokens(docs: DataFrame, path: str = VOCABULARY, sections: Sections = lines) -> DataFrame:
    """doc_id, section, start, end (characters), n_tokens, n_crossing, n_shared, doc_tokens: a row per section of each row.

    The counts of a text's sections add up to the tokens of the whole text. A null or empty text has one empty section
    without tokens. Repeated rows give repeated sections; other columns are not carried on. Nothing is shuffled.
    """

    names = ("doc_id", "section", "start", "end", "n_tokens", "n_crossing", "n_shared", "doc_tokens")

    def step(batch):
        bpe = load(path)
        texts, keys = texts_of(batch), batch.column(0).to_pylist()
        parts: list[list] = [[] for _ in names]
        for key, text, ids in zip(keys, texts, bpe.encode(texts), strict=True):
            begins = sections(text)
            counts = attribute(*token_spans(text, ids, bpe.token_bytes), begins)
            n = len(begins)
            for out, values in zip(
                parts,
                ([key] * n, range(n), begins.tolist(), [*begins[1:].tolist(), len(text)], *[c.tolist() for c in counts], [len(ids)] * n),
                strict=True,
            ):
                out.extend(values)
        yield dict(zip(names, parts, strict=True))

    return map_batches(docs.select("doc_id", "text"), step, ", ".join(f"`{n}` long" for n in names))
