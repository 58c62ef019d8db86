"""XXH32 and XXH64 with any seed, whole or over ordered pieces, and their canonical (big-endian) forms."""

from __future__ import annotations

from collections.abc import Iterable

import xxhash


def xxh32(data: bytes, seed: int = 0) -> int:
    return xxhash.xxh32_intdigest(data, seed)


def xxh64(data: bytes, seed: int = 0) -> int:
    return xxhash.xxh64_intdigest(data, seed)


def fold(pieces: Iterable[bytes], bits: int = 32, seed: int = 0) -> int:
    """The hash of the pieces one after another, without joining them."""
    state = (xxhash.xxh32 if bits == 32 else xxhash.xxh64)(seed=seed)
    for piece in pieces:
        state.update(piece)
    return state.intdigest()


def canonical(value: int, bits: int = 32) -> bytes:
    return value.to_bytes(bits // 8, "big")


def from_canonical(data: bytes) -> int:
    return int.from_bytes(data, "big")


def signed(value: int, bits: int = 64) -> int:
    """The two's-complement number with these bits, as Spark has no unsigned types."""
    return value - (1 << bits) if value >> (bits - 1) else value
