"""Pieces of texts before byte-pair merges, found for a whole slice of texts at once.

The cut points are those of the public pattern (contractions, an optional blank before letters,
numbers or other characters, and white space that leaves its last blank to the next piece):
every point follows from the classes of neighbouring characters, so numpy finds all of them
without running the pattern. Equal pieces are then brought together, so that each different
piece of a slice is encoded once.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import regex

from promptmill.llm.tasks import CACHES
from promptmill.llm.words import mixed, powers

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
_BASE = 0xA0761D6478BD642F
_classes: list[np.ndarray] = []
CACHES.append(_classes)


def classes() -> np.ndarray:
    """Class of every code point, as the ``regex`` library has it."""
    if not _classes:
        table = np.zeros(0x110000, np.uint8)
        points = [i for i in range(0x110000) if not 0xD800 <= i < 0xE000]
        everything = "".join(map(chr, points))
        place = np.array(points)
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
            for m in regex.finditer(pattern, everything):
                table[place[m.start(): m.end()]] = kind
        _classes.append(table)
    return _classes[0]


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return chars, np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))))


def cut_points(chars: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of all pieces of the texts ``chars[offsets[i]:offsets[i + 1]]``, which are laid end to end."""
    n = len(chars)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[chars]
    begins = np.zeros(n + 1, bool)
    begins[offsets] = True  # the first character of a text, or the end
    first, last = begins[:-1], begins[1:]
    run = first.copy()
    run[1:] |= kind[1:] != kind[:-1]
    blank = chars == 32
    space = kind == SPACE
    after_blank = np.zeros(n, bool)
    after_blank[1:] = blank[:-1]
    after_blank &= ~first
    cut = run & (space | ~after_blank)
    # the last of some white space that is followed by something else
    ends = space & ~last
    ends[:-1] &= ~space[1:]
    ends[-1:] = False
    cut |= ends
    quote = np.flatnonzero((chars == 39) & run & ~after_blank)
    stop = np.searchsorted(offsets, quote, "right")
    room = offsets[np.minimum(stop, len(offsets) - 1)] - quote
    for text in CONTRACTIONS:
        if not len(quote):
            break
        fits = room >= len(text)
        for k, c in enumerate(text[1:], 1):
            fits = fits & (chars[np.minimum(quote + k, n - 1)] == ord(c))
        at = quote[fits]
        cut[at + 1] = False
        after = at + len(text)
        after = after[after < n]
        # a new piece begins there: always, if something other than a text's end or a cut follows
        cut[after] |= ~after_blank[after]
        quote, room = quote[~fits], room[~fits]
    return np.flatnonzero(cut)


def unique_pieces(chars: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A representative (its index) for every different piece, and which of them each piece is. Exact: contents are compared."""
    end = np.append(start[1:], len(chars))
    up, down = powers(len(chars) + 1, _BASE)
    code = (chars.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    code ^= code >> np.uint64(29)
    total = np.zeros(len(chars) + 1, np.uint64)
    np.cumsum(code * up[:-1], out=total[1:])
    key = mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    _, sample, which = np.unique(key, return_index=True, return_inverse=True)
    # every piece must equal its representative, character by character
    size = end - start
    twin = sample[which]
    shift = np.repeat(start[twin] - start, size)
    if (size != size[twin]).any() or (chars != chars[np.arange(len(chars)) + shift]).any():
        raise ValueError("two different pieces have the same 64-bit hash")
    return sample, which


def encode_slice(texts: list[str], known: dict[str, bytes], encode: Callable[[list[str]], list[bytes]], most: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the texts, end to end, and the first of each text; ``encode`` gives ids as little-endian 32-bit values.

    ``known`` keeps pieces met before and is emptied when it has more than ``most`` of them.
    """
    chars, offsets = code_points(texts)
    start = cut_points(chars, offsets)
    if not len(start):
        return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
    sample, which = unique_pieces(chars, start)
    joined, end = "".join(texts), np.append(start[1:], len(chars))
    order = np.argsort(start[sample])  # in the order of the text, so that what is cut out and looked up lies together
    place = np.empty(len(sample), np.int64)
    place[order] = np.arange(len(sample))
    sample, which = sample[order], place[which]
    pieces = [joined[a:b] for a, b in zip(start[sample].tolist(), end[sample].tolist(), strict=True)]
    if len(known) > most:
        known.clear()
    coded = list(map(known.get, pieces))
    fresh = [i for i, c in enumerate(coded) if c is None]
    if fresh:
        new = [pieces[i] for i in fresh]
        for i, p, c in zip(fresh, new, encode(new), strict=True):
            known[p] = coded[i] = c
    size = np.fromiter(map(len, coded), np.int64, len(coded)) >> 2
    flat = np.frombuffer(b"".join(coded), "<u4")
    at = np.concatenate(([0], np.cumsum(size)))
    count = size[which]
    first = np.concatenate(([0], np.cumsum(count)))
    ids = flat[np.repeat(at[which] - first[:-1], count) + np.arange(first[-1])]
    return ids, first[np.searchsorted(start, offsets)]
