"""Base64 runs with something before them or over lines, and bytes that aren't clean text."""

import base64
import gzip
import random
import zlib

import pytest

from tallyloom.llm import secret_scan

SECRET = b"password=hunter2hunter2"


def b64(raw):
    return base64.b64encode(raw).decode()


def wrapped(raw):
    return base64.encodebytes(raw).decode().rstrip("\n")


NOISE = random.Random(3).randbytes(300)
LAYERS = {
    "path": "https://h.example/d/" + b64(SECRET),
    "prefix": "blob_" + b64(SECRET),
    "prefix and gzip": "blob/x/" + b64(gzip.compress(SECRET, mtime=0)),
    "prefix and zlib": "ab-" + b64(zlib.compress(SECRET)),
    "over a line end": wrapped(b"x" * 50 + SECRET + b"y" * 50),
    "wrapped gzip": wrapped(gzip.compress(NOISE.hex().encode()[:90] + b" " + SECRET, mtime=0)),
    "windows lines": wrapped(b"x" * 50 + SECRET + b"y" * 90).replace("\n", "\r\n"),
    "zeros": b64(b"\0user\0" + SECRET),
    "odd bytes": b64(NOISE + SECRET + NOISE),
    "utf-16": b64(SECRET.decode().encode("utf-16")),
    "utf-16 big": b64(b"!" + SECRET.decode().encode("utf-16-be")),
}


@pytest.mark.parametrize("name", LAYERS)
def test_layers_that_are_not_isolated_text(name):
    text = f"données {LAYERS[name]} the end"
    found = [(a, b) for a, k, b in secret_scan.all_spans(text) if k == 0]
    assert found and all(8 <= a < b <= len(text) - 8 for a, b in found)
    assert secret_scan.masked(text).endswith("[SECRET] the end")
