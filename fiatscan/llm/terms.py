"""Terms of texts as bytes: runs of kept bytes, A-Z lowered. Every byte from 0x80 on is kept, so UTF-8 needs no decoding."""

from __future__ import annotations

from collections.abc import Iterator

CHUNK = 1 << 20


def fold_table(digits: bool) -> bytes:
    """For bytes.translate: letters, digits if asked for, and bytes from 0x80 on stay, A-Z lowered; others become spaces."""
    keep = b"abcdefghijklmnopqrstuvwxyz" + (b"0123456789" if digits else b"")
    return bytes(b if b >= 0x80 or b in keep else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def text_runs(folded: bytes, chunk: int = CHUNK) -> Iterator[bytes]:
    """A folded text in parts of about `chunk` bytes, cut at spaces, so that a very long text never is one list of terms."""
    start = 0
    while start < len(folded):
        end = folded.find(b" ", start + chunk)
        end = len(folded) if end < 0 else end
        yield folded[start:end]
        start = end


def term_runs(text: bytes, table: bytes, chunk: int = CHUNK) -> Iterator[list[bytes]]:
    """The terms of a text in order, part by part."""
    for part in text_runs(text.translate(table), chunk):
        yield part.split()
