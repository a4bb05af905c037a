"""Secrets in large and nested streams, behind long runs, and in layers that are mostly no text."""

from __future__ import annotations

import base64
import gzip
import random
import time
import zlib

import pytest

from ledgerloom.llm import secrets

SECRET = "password=hunter22"


def kinds(text):
    base, every = secrets.scan(text)
    return {k for k, *_ in set(every) - set(base)}


def wrap(data: bytes) -> str:
    return "see " + base64.b64encode(data).decode() + " end"


@pytest.fixture
def small_pieces(monkeypatch):
    monkeypatch.setattr(secrets, "PIECE", 1 << 12)
    monkeypatch.setattr(secrets, "OVERLAP", 1 << 8)


def noise(seed, n):
    return random.Random(seed).randbytes(n)


@pytest.mark.parametrize("outer", [gzip.compress, zlib.compress])
def test_a_stream_within_a_stream_is_read_to_its_end(small_pieces, outer):
    inner = zlib.compress(noise(1, 50_000).hex().encode()[:60_000] + b" " + SECRET.encode())
    assert len(inner) > 4 * secrets.PIECE
    assert "assign" in kinds(wrap(outer(inner))) and "assign" in kinds(wrap(outer(gzip.compress(outer(inner)))))


@pytest.mark.parametrize("ahead", range(12))
@pytest.mark.parametrize("lines", [False, True])
def test_base64_over_the_border_of_pieces(small_pieces, ahead, lines):
    run = base64.b64encode(noise(2, 9_000).hex().encode() + SECRET.encode())
    if lines:
        run = b"\n".join(run[k : k + 76] for k in range(0, len(run), 76))
    data = b"x " * 1000 + b"." * ahead + b" " + run + b" ;"
    assert "assign" in kinds(wrap(zlib.compress(data)))


def test_secrets_on_the_border_of_pieces(small_pieces):
    for at in range(4060, 4110, 3):
        assert kinds(wrap(zlib.compress(b". " * (at // 2) + SECRET.encode() + b" ." * 2000))) == {"assign"}


def test_streams_that_hold_themselves_or_break_off(small_pieces):
    assert "assign" in kinds(wrap(zlib.compress(SECRET.encode() + b" ." * 50_000)[:-30]))
    assert "assign" in kinds(wrap(gzip.compress(b"one") + gzip.compress(SECRET.encode())))
    assert kinds(wrap(b"\x1f\x8b" + noise(3, 400))) == set()


def test_layers_that_are_mostly_no_text():
    assert "assign" in kinds(wrap(bytes(range(1, 9)) * 30 + SECRET.encode() + b"\x01\x02\x03" * 40))
    assert kinds(wrap(noise(5, 3000))) == set()


def test_long_runs_take_time_in_proportion():
    rng = random.Random(1)
    run = "".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFG0123456789", k=1_000_000))
    began = time.time()
    assert "assign" in kinds(run + " password%3Dhunter22 " + run)
    assert time.time() - began < 8
    small = time.time()
    list(secrets.PERCENT.finditer("a" * 1_000_000 + " %41"))
    assert time.time() - small < 1


def test_percent_runs_are_what_they_were():
    import re

    plain = re.compile(r"(?:[A-Za-z0-9+/_.=:-]*%[0-9A-Fa-f]{2})+[A-Za-z0-9+/_.=:-]*")
    rng = random.Random(2)
    for _ in range(3000):
        t = "".join(rng.choices(["%", "4", "1", "a", "zz", " ", "%41", "=", "%%", "é"], k=rng.randint(0, 20)))
        assert [m.span() for m in plain.finditer(t)] == [m.span() for m in secrets.PERCENT.finditer(t)], t
