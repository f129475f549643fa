"""Encoding against the tokenizers library; counts, packing and codec by brute force."""

import hashlib
import random
import zlib
from itertools import combinations_with_replacement

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tallyloom.llm import bpe_codec, packing, token_counts
from tallyloom.llm.bpe import Bpe

FILES = ("word_bpe_49k.json", "byte_bpe_50k.json")


def library(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.no_padding()
    t.no_truncation()
    return t


def tricky():
    rnd = random.Random(3)
    texts = ["", " ", "  a ", "\n\n 's it's I'll 'stuff ''s \"'s", "x<|startoftext|><|endoftext|> y", "aaaa" * 99, "İ ΣΑΣ ½ x²", "a\r\n\tb  c", "\x1c\x85 b"]
    texts += ["".join(rnd.choice(" '\nasterlvdm1²É<|>\t中") for _ in range(rnd.randrange(50))) for _ in range(1500)]
    return texts + ["".join(rnd.choice("abcdefgABC0123+/") for _ in range(n)) for n in (300, 511, 512, 513, 2500)]


@pytest.mark.parametrize("name", FILES)
def test_encoding_equals_the_library(name):
    texts, bpe, lib = tricky(), Bpe(public_tokenizers.path(name)), library(name)
    want = [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
    assert [i.tolist() for i in bpe.encode(texts)] == want
    if name.startswith("word"):
        assert all(bpe.decode(i) == lib.decode(i, skip_special_tokens=False) for i in want)


@pytest.mark.parametrize("name", FILES)
def test_every_code_point_equals_the_library(name):
    bpe, lib = Bpe(public_tokenizers.path(name)), library(name)
    points = [*range(0xD800), *range(0xE000, 0x40000), *range(0xE0000, 0xE0200)]
    texts = [f"a{chr(c)}1\u0301{chr(c)}! {chr(c)}\u0327b" for c in points]
    for at in range(0, len(texts), 20_000):
        part = texts[at : at + 20_000]
        want = lib.encode_batch(part, add_special_tokens=False)
        wrong = [t for t, e, i in zip(part, want, bpe.encode(part), strict=True) if e.ids != i.tolist()]
        assert not wrong, (len(wrong), [ascii(t) for t in wrong[:5]])


def test_long_words_by_queue_equal_the_rounds():
    bpe = Bpe(public_tokenizers.path(FILES[1]))
    word = b"thethetheabababa" * 20
    rounds, _ = bpe.merge_words([word])
    assert bpe.merge_by_queue(bpe.inner[np.frombuffer(word, np.uint8)].tolist()) == rounds.tolist()


def test_a_small_cache_changes_nothing():
    path = public_tokenizers.path(FILES[1])
    texts = tricky()[:400]
    small = Bpe(path, cache_words=1)
    assert [i.tolist() for t in texts for i in small.encode([t])] == [i.tolist() for i in Bpe(path).encode(texts)]


def test_codec(messy, nothing):
    lib = library(FILES[0])
    got = sorted(map(tuple, bpe_codec.digests(messy).collect()), key=str)
    want = []
    for r in messy.collect():
        ids = lib.encode(r["text"] or "", add_special_tokens=False).ids
        want.append(
            (r["doc_id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest())
        )
    assert got == sorted(want, key=str)
    assert bpe_codec.digests(nothing).count() == 0
    decoded = {r["doc_id"]: r["text"] for r in bpe_codec.decode(bpe_codec.encode(messy)).collect()}
    assert decoded[2] == "" and decoded[1].startswith("the</w> quick</w>")


def test_section_counts(messy, nothing):
    lib = library(FILES[1])
    want = []
    for r in messy.collect():
        text = r["text"] or ""
        enc = lib.encode(text, add_special_tokens=False)
        starts = [0, *[i + 1 for i, c in enumerate(text) if c == "\n" and i + 1 < len(text)]]
        ends = [*starts[1:], len(text)]
        for n, (a, b) in enumerate(zip(starts, ends, strict=True)):
            own = [(s, e) for s, e in enc.offsets if a <= s < b]
            want.append((r["doc_id"], n, a, b, len(own), sum(e > b for _, e in own), sum(s < a < e for s, e in enc.offsets), len(enc.ids)))
    assert sorted(map(tuple, token_counts.section_tokens(messy).collect()), key=str) == sorted(want, key=str)
    assert token_counts.section_tokens(nothing).count() == 0


def test_filling_is_closest_to_capacity():
    rnd = random.Random(5)
    for _ in range(60):
        capacity = rnd.randrange(5, 30)
        counts = {rnd.randrange(1, capacity + 1): rnd.randrange(1, 4) for _ in range(rnd.randrange(1, 5))}
        opener = max(counts)
        picked = packing.fill(counts, opener, capacity)
        assert picked[opener] >= 1 and all(n <= counts[k] for k, n in picked.items())
        total = sum(k * n for k, n in picked.items())
        pool = [k for k, n in counts.items() for _ in range(n)]
        best = max(
            (sum(c) for size in range(1, len(pool) + 1) for c in combinations_with_replacement(sorted(counts), size) if opener in c and sum(c) <= capacity and all(c.count(k) <= counts[k] for k in c)),
        )
        assert total == best


def test_packing(messy, nothing, monkeypatch):
    lib = library(FILES[1])
    monkeypatch.setattr(packing, "PART_ROWS", 3)
    rows = packing.pack(messy, capacity=64).collect()
    docs = {}
    for r in messy.collect():
        docs.setdefault(r["doc_id"], []).append(np.array([*lib.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4"))
    pieces = {}
    for r in rows:
        ids = docs[r["doc_id"]][0]
        assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
    for key, ids in docs.items():
        assert sorted(pieces[key]) == sorted([(a, min(64, len(i) - a)) for i in ids for a in range(0, len(i), 64)])
    windows = {}
    for r in rows:
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert len(windows) <= sum(r["length"] for r in rows) // 64 + 2
    assert packing.pack(nothing).count() == 0
