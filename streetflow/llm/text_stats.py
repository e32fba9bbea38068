"""Counts over whole texts, computed for Arrow batches with array operations."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from streetflow.llm.common import IS_SPACE, text_pieces, windows, word_hash, words

#: Texts whose features are counted together; the counts by byte pairs take some forty times as much memory.
FEATURE_BYTES = 500_000
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
NOT_TAIL = np.ones(256, bool)
NOT_TAIL[0x80:0xC0] = False
#: Classes of bytes: lower, upper, digit, blank, line end, stop, exclamation, bracket or quote, symbol, control,
#: first and further bytes of other scripts.
N_CLASSES = 12
BYTE_CLASS = np.full(256, 8, np.uint8)
BYTE_CLASS[97:123], BYTE_CLASS[65:91], BYTE_CLASS[48:58], BYTE_CLASS[[9, 32]], BYTE_CLASS[10] = 0, 1, 2, 3, 4
BYTE_CLASS[list(b".,;:")], BYTE_CLASS[list(b"!?")], BYTE_CLASS[list(b"'\"()[]{}-")] = 5, 6, 7
BYTE_CLASS[:9], BYTE_CLASS[11:32], BYTE_CLASS[127], BYTE_CLASS[0xC0:], BYTE_CLASS[0x80:0xC0] = 9, 9, 9, 10, 11
N_FEATURES = N_CLASSES * N_CLASSES + 7


def per_text(flag: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of ``flag`` over each text."""
    total = np.concatenate(([0], np.cumsum(flag, dtype=np.int64)))
    return total[at[1:]] - total[at[:-1]]


def by_text(text: np.ndarray, n: int, flag: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(text if flag is None else text[flag], minlength=n).astype(np.int64)


def seen_before(text: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each (text, value): is it equal to an earlier one, and does it occur twice or more in its text."""
    earlier, many = np.zeros(len(value), bool), np.zeros(len(value), bool)
    if len(value):
        order = np.lexsort((np.arange(len(value)), value, text))
        same = (value[order][1:] == value[order][:-1]) & (text[order][1:] == text[order][:-1])
        earlier[order[1:]] = same
        many[order[1:]] = same
        many[order[:-1]] |= same
    return earlier, many


def repeated_words(text: np.ndarray, hashes: np.ndarray, k: int = 5) -> np.ndarray:
    """Words that lie in a window of ``k`` words found twice or more in their text."""
    n = len(text) - k + 1
    covered = np.zeros(len(text), bool)
    if n <= 0:
        return covered
    whole = text[:n] == text[k - 1:]
    at = np.flatnonzero(whole)
    many = at[seen_before(text[at], windows(hashes, k)[at])[1]]
    edge = np.zeros(len(text) + 1, np.int32)
    np.add.at(edge, many, 1)
    np.add.at(edge, many + k, -1)
    return np.cumsum(edge)[:-1] > 0


def duplicate_lines(data: np.ndarray, at: np.ndarray, word_text: np.ndarray, word_start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text: lines with a word, and how many of them equal an earlier line."""
    n = len(at) - 1
    cut = np.flatnonzero(data == 10)
    start = np.unique(np.concatenate((at[:-1][at[1:] > at[:-1]], cut + 1)))
    start = start[start < len(data)]
    if not len(start):
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    end = np.concatenate((start[1:], [len(data)]))
    end = end - ((data[end - 1] == 10) & (end > start))
    text = np.searchsorted(at, start, "right") - 1
    has_word = np.zeros(len(start), bool)
    if len(word_start):
        has_word[np.searchsorted(start, word_start, "right") - 1] = True
    start, end, text = start[has_word], end[has_word], text[has_word]
    again = seen_before(text, word_hash(data, start, end))[0]
    return by_text(text, n), by_text(text, n, again)


def rule_counts(column: pa.Array) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words of every text.

    Lines and windows are compared by 64-bit hashes within one text.
    """
    parts: dict[str, list] = {k: [] for k in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")}
    for _, data, at in text_pieces(column):
        n = len(at) - 1
        text, start, _, hashes = words(data, at)
        lines, dup = duplicate_lines(data, at, text, start)
        for k, v in (("n_words", by_text(text, n)), ("word_chars", per_text(NOT_TAIL[data] & ~IS_SPACE[data], at)),
                     ("n_symbols", per_text(SYMBOLS[data], at)), ("n_lines", lines), ("n_dup_lines", dup),
                     ("n_repeat_words", by_text(text, n, repeated_words(text, hashes)))):
            parts[k].append(v)
    return {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in parts.items()}


def features(column: pa.Array) -> np.ndarray:
    """(texts, N_FEATURES): shares of neighbouring byte classes, then length, word and repetition figures."""
    out = []
    for _, data, at in text_pieces(column, FEATURE_BYTES):
        n = len(at) - 1
        size = np.maximum(np.diff(at), 1)
        text, start, end, hashes = words(data, at)
        n_words = np.maximum(by_text(text, n), 1)
        table = np.zeros((n, N_FEATURES), np.float32)
        if len(data) > 1:
            kind = BYTE_CLASS[data].astype(np.int64)
            owner = np.repeat(np.arange(n), np.diff(at))
            inner = owner[1:] == owner[:-1]
            pair = (owner[1:] * N_CLASSES + kind[:-1]) * N_CLASSES + kind[1:]
            counts = np.bincount(pair[inner], minlength=n * N_CLASSES * N_CLASSES)
            table[:, :N_CLASSES * N_CLASSES] = np.sqrt(counts.reshape(n, -1) / size[:, None])
        next_same = np.zeros(len(text), bool)
        if len(text):
            next_same[1:] = (hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])
        lines, dup = duplicate_lines(data, at, text, start)
        table[:, N_CLASSES * N_CLASSES:] = np.stack([
            np.log1p(np.diff(at)) / 10, np.log1p(by_text(text, n)) / 10,
            np.log1p(np.bincount(text, end - start, n) / n_words) / 3,
            by_text(text, n, next_same) / n_words,
            by_text(text, n, repeated_words(text, hashes)) / n_words,
            by_text(text, n, seen_before(text, hashes)[0]) / n_words,
            dup / np.maximum(lines, 1)], 1)
        out.append(table)
    return np.concatenate(out) if out else np.zeros((0, N_FEATURES), np.float32)
