"""Hashed n-grams of whole texts, and counts that describe how a text is written."""

from __future__ import annotations

import numpy as np
import xxhash

from tallywright.llm.tasks import hashes_of, window_hashes

#: Hashed character 3-grams lie in the lower half, words and word pairs in the upper.
SIZE = 1 << 16
_HALF_BITS = 15
_HALF = 1 << _HALF_BITS
_PLACES = np.array([2654435761, 2246822519, 3266489917], np.uint32)
#: So many n-grams of neutral weight are added to those of each kind, so that few prove little.
_NEUTRAL = 40
_SYMBOLS = b"#*$%&|<>"


def ngram_groups(text: bytes) -> list[np.ndarray]:
    """Feature numbers of all n-grams, one array per kind of n-gram."""
    groups = []
    data = np.frombuffer(text, np.uint8).astype(np.uint32)
    if len(data) > 2:
        folded = data[:-2] * _PLACES[0] ^ data[1:-1] * _PLACES[1] ^ data[2:] * _PLACES[2]
        folded ^= folded >> np.uint32(15)
        groups.append(folded * _PLACES[0] >> np.uint32(32 - _HALF_BITS))
    words = text.split()
    if words:
        hashes = hashes_of(words)
        groups.append(_HALF + (hashes & np.uint64(_HALF - 1)).astype(np.int64))
        if len(words) > 1:
            pairs = window_hashes(hashes, 2)
            pairs[hashes[1:] == hashes[:-1]] = 1  # a word said twice is one feature
            groups.append(_HALF + (pairs & np.uint64(_HALF - 1)).astype(np.int64))
    return groups


def sparse_row(groups: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Features of a text and their shares among its n-grams of each kind."""
    numbers, values = [], []
    for group in groups:
        distinct, counts = np.unique(group, return_counts=True)
        numbers.append(distinct)
        values.append(counts / (len(group) + _NEUTRAL))
    if not numbers:
        return np.empty(0, np.int64), np.empty(0)
    return np.concatenate(numbers), np.concatenate(values)


def margin(groups: list[np.ndarray], weights: np.ndarray) -> float:
    """The linear score of a text: per kind of n-gram the mean of its weights."""
    return float(sum(weights[group].sum() / (len(group) + _NEUTRAL) for group in groups))


def style_group(measures: dict[str, float]) -> np.ndarray:
    """What describes the writing as features: each measure's step on a logarithmic scale.

    Each is told so often that it weighs as much as n-grams do.
    """
    steps = [
        xxhash.xxh3_64_intdigest(f"{name} {round(4 * np.log2(value + 0.01))}") & (_HALF - 1)
        for name, value in measures.items()
        if name != "words"
    ]
    return np.repeat(_HALF + np.array(steps, np.int64), _NEUTRAL)


def rule_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of a text."""
    words = text.split()
    joined = np.frombuffer(b"".join(words), np.uint8)
    chars = int(((joined & 0xC0) != 0x80).sum())
    symbols = sum(text.count(_SYMBOLS[at : at + 1]) for at in range(len(_SYMBOLS)))
    lines = [line for line in text.split(b"\n") if line.strip(b" \t\r\x0b\x0c")]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words)


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of three that occur twice or more."""
    if len(words) < 4:
        return 0
    windows = window_hashes(hashes_of(words), 3)
    _, kind, counts = np.unique(windows, return_inverse=True, return_counts=True)
    twice = counts[kind] > 1
    covered = np.zeros(len(words), bool)
    for shift in range(3):
        covered[shift : shift + len(twice)] |= twice
    return int(covered.sum())


def style(text: bytes) -> dict[str, float]:
    """Shares that heuristics judge a text by."""
    words = text.split()
    count = max(len(words), 1)
    letters = sum(map(len, words))
    upper = sum(word.isupper() and len(word) > 1 for word in words)
    ends = sum(text.count(mark) for mark in (b". ", b".\n", b"! ", b"? ")) + text.endswith((b".", b"!", b"?"))
    n_words, chars, symbols, dup_lines, repeats = rule_counts(text)
    lines = [line for line in text.split(b"\n") if line.strip()]
    return {
        "words": n_words,
        "mean_word": chars / count,
        "symbols": symbols / count,
        "punctuation": sum(text.count(mark) for mark in (b"!", b"?", b"|", b"*", b"#", b"$", b"%", b"&")) / max(letters, 1),
        "upper": upper / count,
        "repeats": repeats / count,
        "same_next": sum(a == b for a, b in zip(words, words[1:], strict=False)) / count,
        "distinct": len(set(words)) / count,
        "dup_lines": dup_lines / max(len(lines), 1),
        "sentences": ends / count,
    }

