"""Byte-pair encoding of many words at once.

The symbols of all new words of a batch stand in one flat array. A round finds the rank of each adjacent pair by binary
search over the sorted pair keys, takes the lowest rank of every word, merges those pairs, and looks up only the pairs
that a merge has touched. Words without a mergeable pair leave the array. Encoded words are remembered up to a bound.

A rule whose product takes part in an earlier rule is applied one place at a time, as a queue ordered by rank and place
would do; all others are applied at every place of the word in the same round. Words of more than ``LONG_WORD`` symbols,
which would need very many rounds, go through such a queue.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import repeat

import numpy as np
import regex
from tokenizers import Regex, normalizers
from tokenizers.pre_tokenizers import Split

from tallyloom.llm.common import by_size

LONG_WORD = 512
NONE = np.iinfo(np.int32).max
SPACE_CLASS, LETTER, NUMBER, OTHER = 0, 1, 2, 3


#: the planes that hold letters and numbers; nothing beyond is either, in any version of Unicode
PLANES = [*range(0xD800), *range(0xE000, 0x40000)]


@lru_cache(1)
def classes() -> np.ndarray:
    """Class of each code point: white space, letter, number, other.

    As the tokenizers library sees them: its Unicode version isn't that of Python or of the regex module.
    """
    out = np.full(0x110000, OTHER, np.uint8)
    where, every = np.array(PLANES), "".join(map(chr, PLANES))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE_CLASS, r"\s+")):
        for _, (begin, end) in Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(every):
            out[where[begin:end]] = kind
    return out


@lru_cache(1)
def versioned() -> np.ndarray:
    """Whether a code point may normalise or lower-case otherwise in one Unicode version than in another.

    Those that Python doesn't know may, and those younger than Unicode 3.2 that combine, decompose, take part in a
    composition or have a lower case. For all others both are stable.
    """
    out = np.ones(0x110000, bool)
    texts = list(map(chr, PLANES))
    parts = {chr(int(h, 16)) for t in texts for h in unicodedata.decomposition(t).split() if h[0] != "<"}
    out[PLANES] = [
        unicodedata.ucd_3_2_0.category(t) == "Cn"
        and (unicodedata.category(t) == "Cn" or t in parts or t.lower() != t or unicodedata.combining(t) > 0 or unicodedata.decomposition(t) != "")
        for t in texts
    ]
    return out


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself where printable, else the next free code point from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


@lru_cache(4)
def load(path: str) -> Bpe:
    return Bpe(path)


class Bpe:
    """A vocabulary file of the tokenizers library: byte-level BPE, with or without a word-end suffix."""

    def __init__(self, path: str, cache_words: int = 200_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, model = spec["model"]["vocab"], spec["model"]
        suffix = model["end_of_word_suffix"] or ""
        self.lower = spec["normalizer"] is not None
        self.normalizer = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        self.size = max([*vocab.values(), *self.specials.values()]) + 1
        self.tokens = [""] * self.size
        for text, i in (*vocab.items(), *self.specials.items()):
            self.tokens[i] = text
        stand_in = byte_symbols()
        self.inner = np.array([vocab[c] for c in stand_in], np.int64)
        self.final = np.array([vocab[c + suffix] for c in stand_in], np.int64)
        pairs = [(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.product = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        first_use = np.full(self.size, NONE, np.int64)
        every = np.arange(len(pairs))
        np.minimum.at(first_use, left, every)
        np.minimum.at(first_use, right, every)
        self.everywhere = first_use[self.product] > every
        self.token_bytes = np.array([self._byte_length(i, suffix) for i in range(self.size)], np.int64)
        self.cache_words = cache_words
        self._forget()

    def _byte_length(self, token: int, suffix: str) -> int:
        text = self.tokens[token]
        if text in self.specials:
            return len(text.encode())
        return len(text[: -len(suffix)] if suffix and text.endswith(suffix) else text)

    def _forget(self) -> None:
        self.cache: dict[str, int] = {}
        self.word_offset = np.zeros(1, np.int64)  # of word i: from [i] to [i + 1] in word_ids
        self.word_ids = np.zeros(0, np.int32)

    # -- words ------------------------------------------------------------------------------------------------------

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE).astype(np.int32)

    def merge_words(self, words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and how many each has. Empty words have none."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8)
        symbol = self.inner[flat]
        word = np.repeat(np.arange(len(words)), lengths)
        ends = np.cumsum(lengths)[lengths > 0] - 1
        symbol[ends] = self.final[flat[ends]]
        done_word, done_symbol = [], []
        for i in np.flatnonzero(lengths > LONG_WORD):
            mine = word == i
            ids = self.merge_by_queue(symbol[mine].tolist())
            done_word.append(np.full(len(ids), i))
            done_symbol.append(np.array(ids, np.int64))
        if done_word:
            short = lengths[word] <= LONG_WORD
            word, symbol = word[short], symbol[short]
        rank = np.full(len(symbol), NONE, np.int32)
        inside = np.flatnonzero(word[1:] == word[:-1])
        rank[inside] = self.rank_of(symbol[inside], symbol[inside + 1])
        while len(symbol):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            sizes = np.diff(np.r_[first, len(word)])
            lowest = np.minimum.reduceat(rank, first)
            open_ = lowest != NONE
            if not open_.all():
                alive = np.repeat(open_, sizes)
                done_word.append(word[~alive])
                done_symbol.append(symbol[~alive])
                word, symbol, rank = word[alive], symbol[alive], rank[alive]
                lowest, sizes = lowest[open_], sizes[open_]
                if not len(symbol):
                    break
            hit = np.flatnonzero(rank == np.repeat(lowest, sizes))
            run = np.r_[True, np.diff(hit) != 1]  # the same pair may overlap itself: every other place counts
            place = np.arange(len(hit)) - np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
            hit = hit[place % 2 == 0]
            one = ~self.everywhere[rank[hit]]
            if one.any():
                hit = hit[~one | np.r_[True, word[hit[1:]] != word[hit[:-1]]]]
            symbol[hit] = self.product[rank[hit]]
            touched = np.zeros(len(symbol), bool)
            touched[hit] = True
            touched[np.maximum(hit - 1, 0)] = True
            keep = np.ones(len(symbol), bool)
            keep[hit + 1] = False
            # the place before a merge may itself have been merged into its left neighbour
            gone = np.flatnonzero(~keep & touched)
            touched[gone - 1] = True
            word, symbol, rank, touched = word[keep], symbol[keep], rank[keep], touched[keep]
            look = np.flatnonzero(touched)
            rank[look] = NONE
            look = look[look + 1 < len(word)]
            look = look[word[look] == word[look + 1]]
            rank[look] = self.rank_of(symbol[look], symbol[look + 1])
        if not done_word:
            return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
        owner = np.concatenate(done_word)
        order = np.argsort(owner, kind="stable")
        return np.concatenate(done_symbol)[order].astype(np.int32), np.bincount(owner, minlength=len(words))

    def merge_by_queue(self, symbols: list[int]) -> list[int]:
        """One long word: pairs in a heap by rank and place, neighbours linked."""
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        alive = [True] * n
        start = self.rank_of(np.array(symbols[:-1], np.int64), np.array(symbols[1:], np.int64)).tolist()
        heap = [(r, i, symbols[i], symbols[i + 1]) for i, r in enumerate(start) if r != NONE]
        heapq.heapify(heap)

        def offer(i: int, j: int) -> None:
            key = symbols[i] * self.size + symbols[j]
            at = int(np.searchsorted(self.keys, key))
            if at < len(self.keys) and self.keys[at] == key:
                heapq.heappush(heap, (int(self.ranks[at]), i, symbols[i], symbols[j]))

        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or symbols[i] != a or symbols[j] != b:
                continue
            symbols[i] = int(self.product[r])
            alive[j] = False
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
                offer(i, after[i])
            if before[i] >= 0:
                offer(before[i], i)
        return [s for s, a in zip(symbols, alive, strict=True) if a]

    def _indexes(self, words: list[str]) -> np.ndarray:
        """Places of the words in the cache, new words encoded first."""
        if len(self.cache) > self.cache_words:
            self._forget()
        index = np.fromiter(map(self.cache.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(index < 0)
        if len(missing):
            new = list(dict.fromkeys(words[i] for i in missing.tolist()))
            ids, counts = self.merge_words([w.encode() for w in new])
            at = len(self.cache)
            self.word_offset = np.r_[self.word_offset, self.word_offset[-1] + np.cumsum(counts)]
            self.word_ids = np.r_[self.word_ids, ids]
            self.cache.update(zip(new, range(at, at + len(new)), strict=True))
            index[missing] = np.fromiter((self.cache[words[i]] for i in missing.tolist()), np.int64, len(missing))
        return index

    # -- texts ------------------------------------------------------------------------------------------------------

    def _cut(self, codes: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the words of joined texts; ``begins`` are the places where a text begins."""
        n = len(codes)
        kind = classes()[codes]
        edge = np.zeros(n + 4, bool)  # a text ends before this place; the last ones stand for the end of all
        edge[begins[begins < n]] = True
        edge[n:] = True
        cut = np.zeros(n + 4, bool)
        cut[0] = True
        cut[1:n] = kind[1:] != kind[:-1]
        cut |= edge
        if self.lower:
            cut[:n] |= kind == NUMBER
        else:
            starts = np.flatnonzero(cut[:n])
            ends = np.r_[starts[1:], n]
            blank = (kind[starts] == SPACE_CLASS) & ~edge[ends]
            end = ends[blank]
            glued = codes[end - 1] == 32
            cut[end - 1] = True
            cut[end[glued]] = False
        quote = np.flatnonzero((codes == 39) & cut[:n])
        quote = quote[cut[quote + 1] & ~edge[quote + 1]]
        padded = np.r_[codes, np.zeros(4, codes.dtype)]
        c1, c2 = padded[quote + 1], np.where(edge[quote + 2], 0, padded[quote + 2])
        s, t, m, d, r, v, e, ell = (ord(c) for c in "stmdrvel")
        one = quote[np.isin(c1, (s, t, m, d))]
        two = quote[(((c1 == r) | (c1 == v)) & (c2 == e)) | ((c1 == ell) & (c2 == ell))]
        cut[one + 1] = False
        cut[one + 2] = True
        cut[two + 1] = False
        cut[two + 2] = False
        cut[two + 3] = True
        starts = np.flatnonzero(cut[:n])
        ends = np.r_[starts[1:], n]
        if self.lower:
            kept = kind[starts] != SPACE_CLASS
            starts, ends = starts[kept], ends[kept]
        return starts, ends

    def _normal(self, text: str) -> str:
        if not self.lower:
            return text
        if text.isascii():
            return text.lower()
        if versioned()[np.frombuffer(text.encode("utf-32-le"), np.uint32)].any():
            return self.normalizer.normalize_str(text)
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def encode_segments(self, segments: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts without special tokens, in one array, and the count of each text."""
        segments = [self._normal(s) for s in segments]
        joined = "".join(segments)
        counts = np.zeros(len(segments), np.int64)
        if not joined:
            return np.zeros(0, np.int32), counts
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        sizes = np.fromiter(map(len, segments), np.int64, len(segments))
        begins = np.cumsum(sizes) - sizes
        starts, ends = self._cut(codes, begins)
        index = self._indexes([joined[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
        offset, lengths = self.word_offset[index], np.diff(self.word_offset)[index]
        ids = self.word_ids[np.repeat(offset - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())]
        owner = np.searchsorted(begins, starts, "right") - 1  # an empty text owns nothing: the last of equal begins counts
        np.add.at(counts, owner, lengths)
        return ids, counts

    def encode(self, texts: Sequence[str]) -> Iterator[np.ndarray]:
        """Ids of each text; the strings of special tokens become their ids."""
        for part in by_size(texts):
            segments, layouts = [], []
            for text in texts[part]:
                if self.special_pattern is not None and "<|" in text and self.special_pattern.search(text):
                    layout, at = [], 0
                    for m in self.special_pattern.finditer(text):
                        layout += [len(segments), self.specials[m[0]]]
                        segments.append(text[at : m.start()])
                        at = m.end()
                    layouts.append([*layout, len(segments)])
                    segments.append(text[at:])
                else:
                    layouts.append([len(segments)])
                    segments.append(text)
            ids, counts = self.encode_segments(segments)
            ends = np.cumsum(counts)
            for layout in layouts:
                pieces = [ids[ends[x] - counts[x] : ends[x]] if k % 2 == 0 else np.array([x], np.int32) for k, x in enumerate(layout)]
                yield pieces[0] if len(pieces) == 1 else np.concatenate(pieces)

    def decode(self, ids: Sequence[int]) -> str:
        """What the library gives for a vocabulary without a decoder: the tokens joined by spaces."""
        return " ".join(map(self.tokens.__getitem__, ids))
