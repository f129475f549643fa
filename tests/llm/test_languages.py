"""Language bundles by a slow loop, and their memory."""

import random
import subprocess
import sys

import numpy as np

from tallyloom.llm import language_id
from tallyloom.llm.language_id import Encoder


def slow_bundle(encoder, text):
    codes = []
    for c in f" {text.lower()} ":
        k = int(encoder.slots[ord(c)])
        if k or not codes or codes[-1]:
            codes.append(k)
    out = np.zeros(encoder.dim, np.int64)
    for a, b, c in zip(codes, codes[1:], codes[2:], strict=False):
        out += encoder.placed[0][a].astype(int) * encoder.placed[1][b] * encoder.placed[2][c]
    return out


def test_bundles_equal_a_slow_loop(monkeypatch):
    encoder, rnd = Encoder(64), random.Random(3)
    texts = ["Hello, world!! 12 naïve", "", "日本語テキスト です", "a", "!!!"]
    texts += ["".join(rnd.choice("abc é日本 .") for _ in range(rnd.randrange(80))) for _ in range(60)]
    texts += ["".join(chr(rnd.randrange(0x4E00, 0x9FA5)) for _ in range(50)) for _ in range(40)]
    want = [slow_bundle(encoder, t).tolist() for t in texts]
    for grams, some, pairs in ((4096, 512, 8192), (7, 3, 5)):
        monkeypatch.setattr(language_id, "GRAMS", grams)
        monkeypatch.setattr(language_id, "TEXTS", some)
        monkeypatch.setattr(language_id, "PAIRS", pairs)
        got, lettered = encoder.bundles(texts)
        assert got.astype(int).tolist() == want
        assert lettered.tolist() == [any(c.isalpha() for c in t) for t in texts]


def test_large_scripts_and_many_short_texts_need_little_memory():
    code = """
import random, resource, sys
from tallyloom.llm.language_id import Encoder
rnd, encoder = random.Random(1), Encoder()
encoder.bundles(["warm up"])
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
encoder.bundles(["".join(chr(rnd.randrange(0x4E00, 0x9FA5)) for _ in range(1000)) for _ in range(500)])
encoder.bundles(["".join(rnd.choice("abcdefghijklmnop ") for _ in range(20)) for _ in range(25_000)])
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, timeout=300)
    assert int(done.stdout) < 300


def test_prototypes_learn_from_every_document_in_any_order(spark):
    rows = [(i, "the cat sat on the mat" if i % 5 else f"word{i} zebra quokka", "en") for i in range(1, 2600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    few, many = (language_id.learn(docs.repartition(n)) for n in (2, 7))
    assert few.languages == ("en",) and few.prototypes.tolist() == many.prototypes.tolist()
    texts = [r["text"] for r in language_id.known(docs).collect()]
    vectors, _ = Encoder().bundles(texts)
    mean = language_id.unit(language_id.unit(vectors.astype(np.float64)).sum(axis=0))
    assert len(texts) > 1900 and float(few.prototypes[0] @ mean) > 1 - 1e-9
