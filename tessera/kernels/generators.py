"""Seeded test data: compressible noise, sparse bytes, and words."""

from __future__ import annotations

import numpy as np

#: Letters that the words are made from.
CONSONANTS, VOWELS = "bcdfghjklmnprstvz", "aeiou"


def noise(size: int, seed: int = 0, matches: float = 0.5, literals: float | None = None) -> bytes:
    """Bytes of which a share comes from up to 32 KB before; matches >= 1 makes zeros with single bytes between."""
    draw = np.random.default_rng(seed)
    if matches >= 1:
        out = np.zeros(size, np.uint8)
        out[draw.integers(0, max(1, size), size // 65536 + 1) % max(1, size)] = 1
        return out.tobytes()
    skew = matches / 4.5 if literals is None else literals
    weights = np.maximum(1e-9, (1 - skew) ** np.arange(256)) if skew > 0 else np.ones(256)
    out = bytearray()
    while len(out) < size:
        n = int(draw.integers(4, 64))
        if out and draw.random() < matches:
            back = int(draw.integers(1, min(len(out), 32768) + 1))
            piece = bytes(out[-back:])
            out += (piece * (n // back + 1))[:n]
        else:
            out += draw.choice(256, n, p=weights / weights.sum()).astype(np.uint8).tobytes()
    return bytes(out[:size])


def words(size: int, seed: int = 0) -> str:
    """About `size` characters of sentences of made-up words: syllables of a consonant, a vowel and at times another consonant.

    The seed makes a vocabulary of 400 words, of which early ones are commoner.
    """
    draw = np.random.default_rng(seed)

    def syllable() -> str:
        return str(draw.choice(list(CONSONANTS))) + str(draw.choice(list(VOWELS))) + (str(draw.choice(list(CONSONANTS))) if draw.random() < 0.3 else "")

    vocabulary = ["".join(syllable() for _ in range(int(draw.integers(1, 4)))) for _ in range(400)]
    out, length = [], 0
    while length < size:
        sentence = " ".join(vocabulary[int(400 * x * x)] for x in draw.random(int(draw.integers(4, 16))))
        out.append(sentence.capitalize() + ".")
        length += len(out[-1]) + 1
    return " ".join(out)[:size]
