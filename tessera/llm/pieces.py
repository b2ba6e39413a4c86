"""Splitting texts into the pieces that byte-level BPE merges separately.

Works on whole batches with numpy: code points are classed by a table
(letter, number, white space, other), piece starts follow from changes of
class and the white-space and contraction rules of the pattern, and equal
pieces of a batch are found by a 64-bit hash and compared with each other, so
that only different pieces ever become Python strings.
"""

from __future__ import annotations

from itertools import chain

import numpy as np

from tessera.llm.common import ship

ship(__name__)

LETTER, NUMBER, SPACE, OTHER, END = 0, 1, 2, 3, 4
_MIX = np.uint64(0x9E3779B97F4A7C15)
_state: dict = {}


def _classes() -> np.ndarray:
    """Class of every code point; surrogates cannot occur in a text. The code past the last one ends a text."""
    if "classes" not in _state:
        import regex

        table = np.full(0x110001, OTHER, np.uint8)
        points = [chr(c) if not 0xD800 <= c < 0xE000 else " " for c in range(0x110000)]
        every = "".join(points)
        # White space of the pattern is the Unicode property, which leaves out U+001C to U+001F.
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
            for m in regex.finditer(pattern, every):
                table[m.start():m.end()] = kind
        table[0xD800:0xE000] = OTHER
        table[0x110000] = END
        _state["classes"] = table
    return _state["classes"]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    if len(_state.get("powers", ((), ()))[0]) < n:
        size = max(n, 1 << 20)
        base = 0xD1342543DE82EF95
        inverse = pow(base, -1, 1 << 64)
        made = []
        for b in (base, inverse):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        _state["powers"] = tuple(made)
    return _state["powers"]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x + np.uint64(1)) * _MIX
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def piece_starts(codes: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Marks where pieces start. Texts are separated by one END code each."""
    n = len(codes)
    starts = np.empty(n, bool)
    starts[0] = True
    np.not_equal(kinds[1:], kinds[:-1], out=starts[1:])
    after = np.empty(n, np.uint8)
    after[:-1], after[-1] = kinds[1:], END
    # The last white space before a visible character stands apart; a plain space joins what follows.
    last = np.flatnonzero((kinds == SPACE) & (after != SPACE) & (after != END))
    starts[last] = True
    joins = last[codes[last] == 32]
    starts[joins + 1] = False
    # 's 't 'm 'd 're 've 'll, where the apostrophe itself starts a piece.
    marks = np.flatnonzero((codes == 39) & starts & (after == LETTER))
    if len(marks):
        one = codes[marks + 1]
        two = codes[np.minimum(marks + 2, n - 1)]
        short = np.isin(one, (115, 116, 109, 100))
        long = ((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108))
        for hit, width in ((marks[short], 2), (marks[long & ~short], 3)):
            starts[hit + 1] = False
            starts[np.minimum(hit + width, n - 1)] = True
    return starts


def _regrouped(joined: str, codes: np.ndarray, first: np.ndarray, stop: np.ndarray, example: np.ndarray, number: np.ndarray,
               pieces: list[str], step: int = 1 << 18) -> None:
    """Compares every piece with the example of its group, code point by code point, and gives those that differ
    (only the hash was equal) groups of their own."""
    length, own = stop - first, {}
    for k in range(0, len(first), step):
        here = slice(k, k + step)
        n, model = length[here], example[number[here]]
        same = n == length[model]
        n = np.where(same, n, 0)
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        differ = codes[np.repeat(first[here], n) + inside] != codes[np.repeat(first[model], n) + inside]
        wrong = np.flatnonzero(~same).tolist()
        if differ.any():
            wrong += np.unique(np.repeat(np.arange(len(n)), n)[differ]).tolist()
        for i in wrong:
            piece = joined[first[k + i]:stop[k + i]]
            if piece not in own:
                own[piece] = len(pieces)
                pieces.append(piece)
            number[k + i] = own[piece]


def split_batch(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Different pieces, the piece number of every place, and the place where each text begins
    (one more at the end). A text without characters begins where the next one does."""
    joined = "\x00".join(texts) + "\x00"
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32).copy()
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths + 1) - 1
    codes[ends] = 0x110000
    kinds = _classes()[codes]
    starts = piece_starts(codes, kinds)
    starts[ends] = True  # also right behind another end
    first = np.flatnonzero(starts)
    stop = np.append(first[1:], len(codes))
    real = codes[first] != 0x110000
    first, stop = first[real], stop[real]
    begins = np.append(np.searchsorted(first, ends - lengths), len(first))
    power, inverse = _powers(len(codes))
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(_mixed(codes.astype(np.uint64)) * power[:len(codes)], out=sums[1:])
    hashes = (sums[stop] - sums[first]) * inverse[first]
    hashes ^= (stop - first).astype(np.uint64) * _MIX
    _, example, number = np.unique(hashes, return_index=True, return_inverse=True)
    pieces = [joined[a:b] for a, b in zip(first[example].tolist(), stop[example].tolist())]
    _regrouped(joined, codes, first, stop, example, number, pieces)
    return pieces, number, begins


def gather(number: np.ndarray, flat: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all places one after the other, and where each place begins (one more at the end).
    ``flat[offset[k]:offset[k + 1]]`` are the ids of piece k."""
    count = np.diff(offset)[number]
    at = np.concatenate(([0], np.cumsum(count)))
    index = np.arange(at[-1]) + np.repeat(offset[number] - at[:-1], count)
    return flat[index], at


def batches(texts: list[str], limit: int = 3 << 20):
    """Ranges of rows whose texts hold about ``limit`` characters; a longer text is a range of its own."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        if i > begin and size + len(t) > limit:
            yield begin, i
            begin, size = i, 0
        size += len(t) + 1
    if begin < len(texts):
        yield begin, len(texts)


def encode_batches(texts: list[str], to_ids):
    """Ids of each text, in order. ``to_ids`` gives the ids of a list of different pieces;
    memory is bounded by about three million characters or one text."""
    for a, b in batches(texts):
        found, number, begins = split_batch(texts[a:b])
        made = to_ids(found)
        offset = np.concatenate(([0], np.cumsum(np.fromiter(map(len, made), np.int64, len(made)))))
        flat = np.fromiter(chain.from_iterable(made), np.int64, int(offset[-1]))
        ids, at = gather(number, flat, offset)
        bounds = at[begins].tolist()
        for x, y in zip(bounds, bounds[1:]):
            yield ids[x:y]
