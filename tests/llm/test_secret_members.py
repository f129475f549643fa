"""Compressed runs of several members or frames, and of more bytes than a window holds."""

import base64
import bz2
import gzip
import random
import zlib

import pytest
import zstandard

from tallyloom.llm import secret_scan

SECRET = b"password=hunter2hunter2"


def b64(raw):
    return base64.b64encode(raw).decode()


PACKERS = {"gzip": gzip.compress, "zlib": zlib.compress, "bzip2": bz2.compress, "zstd": zstandard.ZstdCompressor().compress}


@pytest.mark.parametrize("name", PACKERS)
def test_every_member_and_byte_is_scanned(name):
    pack = PACKERS[name]
    members = pack(b"hello there") + pack(SECRET)
    nested = pack(pack(b"hello there") + pack(b"more ") + pack(SECRET))
    for raw in (members, nested):
        text = f"see {b64(raw)} end"
        assert any(k == 0 for _, k, _ in secret_scan.all_spans(text)) and secret_scan.masked(text) == "see [SECRET] end"


def test_beyond_64_mb():
    text = f"see {b64(gzip.compress('é '.encode() * (23 << 20) + SECRET, mtime=0))} end"
    assert secret_scan.masked(text) == "see [SECRET] end"


def found(raw):
    return secret_scan.masked(f"see {b64(raw)} end") == "see [SECRET] end"


@pytest.mark.parametrize("name", PACKERS)
def test_every_layer_is_read_and_searched(name):
    pack, gz = PACKERS[name], gzip.compress
    assert found(gz(pack(b"some text") + SECRET))  # what follows a member inside another layer
    assert found(pack(b"HDR\0" + gz(SECRET)))  # a member that doesn't begin its layer
    assert found(gz(b"x" * 5000 + pack(b"y" * 5000 + gz(b"HDR" + pack(SECRET)) + b"tail")))
    cut = pack(random.Random(2).randbytes(9000))
    assert found(gz(cut[:4000] + b" then " + SECRET))  # after damage
    if name in ("gzip", "zlib"):  # the others need a whole block
        assert found(pack(SECRET + b" " * 30 + random.Random(3).randbytes(90_000))[:-50])  # before damage
    assert not found(gz(pack(b"nothing to see here")))


def slowly(raw, depth=0):
    """Whether the secret is in the bytes or in any gzip member in them, tried at every place."""
    if SECRET in raw or depth > 4:
        return SECRET in raw
    for at in range(len(raw)):
        if raw[at : at + 2] == b"\x1f\x8b":
            tool = zlib.decompressobj(31)
            try:
                inner = tool.decompress(raw[at:])
            except zlib.error:
                continue
            if slowly(inner, depth + 1):
                return True
    return False


def test_equals_a_slow_recursive_reader():
    rnd = random.Random(7)
    for _ in range(60):
        raw = SECRET if rnd.random() < 0.5 else b"only some harmless words"
        for _ in range(rnd.randrange(1, 4)):
            before, after = rnd.randbytes(rnd.randrange(40)), rnd.randbytes(rnd.randrange(40))
            raw = before + gzip.compress(raw, mtime=0) + after
        assert found(raw) == slowly(raw)


def test_bytes_stream_by_in_windows(monkeypatch):
    monkeypatch.setattr(secret_scan, "WINDOW", 1 << 12)
    monkeypatch.setattr(secret_scan, "OVERLAP", 1 << 9)
    for at in range(0, 20_000, 611):
        assert found(gzip.compress(b"w " * at + SECRET + b" w" * 3000))
        assert found(gzip.compress(random.Random(at).randbytes(at) + gzip.compress(SECRET) + b" w" * 3000))
        # a run of base64 far longer than what windows share
        assert found(gzip.compress(b"w " * at + b64(b"v " * 4000 + SECRET).encode() + b" w" * 3000))


def test_a_bomb_stays_bounded_and_a_layer_that_holds_itself_ends():
    import tracemalloc

    bomb = gzip.compress(gzip.compress(b"\0" * (24 << 20), mtime=0) + SECRET, mtime=0)
    tracemalloc.start()
    assert found(bomb)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 << 20
    same = secret_scan._Bytes()
    inner = secret_scan._Unpacked(b"BZh9", ())
    mark = secret_scan.hashlib.sha1(b"again").digest()
    inner.above, inner.head = (mark,) * secret_scan.SAME, bytearray(b"again")
    assert inner._known() == b"again" and inner.layer is None and not inner.alive and not list(same.close())
