"""Rewrites a piece model so that the sentencepiece library can serve as the slow way to the same paths."""
import struct

from tickloom.llm.sentencepiece_lattice import _fields


def _number(n):
    out = b""
    while True:
        out += bytes([n & 127 | (128 if n > 127 else 0)])
        n >>= 7
        if not n:
            return out


def _message(fields):
    return b"".join(_number(f << 3 | k) + (_number(v) if k == 0 else (_number(len(v)) if k == 2 else b"") + v) for f, k, v in fields)


def best_path_model(path, least=-100_000.0):
    """The model with the library's best-path search switched on, and scores that its 32-bit sums keep apart."""
    out = []
    with open(path, "rb") as f:
        model = f.read()
    for field, kind, value in _fields(model):
        if field == 1:
            value = _message([(a, b, struct.pack("<f", max(least, struct.unpack("<f", c)[0])) if a == 2 else c) for a, b, c in _fields(value)])
        if field == 2:
            value = _message([(a, b, 1 if a == 3 else c) for a, b, c in _fields(value)])
        out.append((field, kind, value))
    return _message(out)
