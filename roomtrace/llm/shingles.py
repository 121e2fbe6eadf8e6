"""Words and word shingles of many texts at once, as 64-bit numbers."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from roomtrace.llm.common import text_bytes

#: A word, or the end of a token.
WORD_OR_END = re.compile(r"\w+|\n")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xBF58476D1CE4E5B9)
_BASE = np.uint64(0x100000001B3)
#: Words of more bytes are hashed by a digest, all others as polynomials, a place of all words at a time.
LONG_WORD = 256


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers evenly (one to one)."""
    x = x ^ (x >> np.uint64(30))
    x *= _MIX2
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each lower-cased word of all texts, and the first word of each text (one more entry at the end).

    Words are runs of letters, digits and underscores, in any script.  Each distinct blank-separated token is taken apart
    once.
    """
    spaced = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
    firsts = spaced.offsets.to_numpy().astype(np.int64)
    firsts = firsts - firsts[0]
    coded = spaced.flatten().dictionary_encode()
    if not len(coded):
        return np.zeros(0, np.uint64), firsts
    # all tokens at once, as a call for each costs more than its words; a token holds no line end
    tokens = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    found = pa.array(WORD_OR_END.findall("\n".join(tokens).lower() + "\n"), pa.string())
    end = pc.equal(found, "\n").to_numpy(zero_copy_only=False)
    hashes = string_hashes(found.filter(pa.array(~end)))
    ends_at = np.flatnonzero(end)
    counts = np.diff(ends_at, prepend=-1) - 1
    starts = np.cumsum(counts) - counts
    codes = coded.indices.to_numpy(zero_copy_only=False)
    sizes = counts[codes]
    ends = np.cumsum(sizes)
    flat = hashes[np.repeat(starts[codes] - (ends - sizes), sizes) + np.arange(ends[-1])]
    return flat, np.concatenate([[0], ends])[firsts]


def string_hashes(strings: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string: its bytes as a polynomial, then mixed; of a long string, a digest."""
    if not len(strings):
        return np.zeros(0, np.uint64)
    data, offsets = text_bytes(strings)
    sizes = np.diff(offsets)
    total = np.zeros(len(strings), dtype=np.uint64)
    with np.errstate(over="ignore"):
        live = np.flatnonzero(sizes <= LONG_WORD)
        for k in range(int(sizes[live].max()) if len(live) else 0):
            live = live[sizes[live] > k]
            total[live] = (total[live] * _BASE + data[offsets[live] + k] + np.uint64(1)) * _MIX
        for i in np.flatnonzero(sizes > LONG_WORD):
            total[i] = int.from_bytes(hashlib.blake2b(data[offsets[i] : offsets[i + 1]], digest_size=8).digest(), "little")
        return mixed(total ^ (sizes.astype(np.uint64) << np.uint64(40)))


def shingle_hashes(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each run of ``words`` words, text by text, and the first run of each text.

    A text with fewer words has one run of all its words; a text without words has none.
    """
    hashes, firsts = word_hashes(texts)
    sizes = np.diff(firsts)
    runs = np.where(sizes >= words, sizes - words + 1, np.minimum(sizes, 1))
    starts = np.concatenate([[0], np.cumsum(runs)])
    if not starts[-1]:
        return np.zeros(0, np.uint64), starts
    at = np.repeat(firsts[:-1] - starts[:-1], runs) + np.arange(starts[-1])
    left = np.repeat(firsts[1:], runs) - at  # words from here to the end of the text
    with np.errstate(over="ignore"):
        total = np.zeros(len(at), dtype=np.uint64)
        for k in range(words):
            inside = left > k
            total = np.where(inside, total * _BASE * _MIX + hashes[np.minimum(at + k, len(hashes) - 1)], total)
    return mixed(total), starts


def weighted(hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes of each text in ascending order, how often each occurs, and the first of each text."""
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return hashes[at], np.diff(np.concatenate([at, [len(hashes)]])), np.searchsorted(owner[at], np.arange(len(starts)))
