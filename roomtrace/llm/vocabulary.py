"""Token ids of many texts at once with a public tokenizer file.

Texts are cut at boundaries that no token can cross, each distinct piece is
encoded once by the library, in batches, and the ids are put together again.

* ``drop``: vocabularies that normalise white space and drop it.  Every blank and
  line break is a boundary.
* ``lead``: byte-level vocabularies that keep a blank as the first character of
  the word behind it.  A single blank, or a single line break, between characters
  that are not white space is a boundary.
* ``none``: any other file.  A text is one piece.
"""

import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A single blank that is a boundary for either kind, whatever surrounds it further away.
SAFE_BLANK = re.compile(r"(?<=[!-~\w]) (?=[!-~\w])")
#: Pieces each worker remembers, and pieces encoded by one call of the library.
REMEMBERED, AT_ONCE = 400_000, 4_000
#: Longer texts are encoded in parts of about so many characters, cut at safe blanks.
PART_CHARS = 1 << 20

#: Bytes that may begin white space other than a blank or a line break.
_ODD = np.zeros(256, dtype=bool)
_ODD[:32] = True
_ODD[10] = False
_ODD[[0xC2, 0xE1, 0xE2, 0xE3]] = True


def boundary_kind(spec: dict) -> str:
    """How the file's own rules let a text be cut."""
    before = spec.get("pre_tokenizer") or {}
    if before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not spec.get("normalizer"):
        return "lead"
    parts = (spec.get("normalizer") or {}).get("normalizers", [])
    blanks = any(p.get("type") == "Replace" and p.get("pattern", {}).get("Regex") == r"\s+" and p.get("content") == " " for p in parts)
    first = (before.get("pretokenizers") or [{}])[0]
    if blanks and first.get("type") == "Split" and first.get("behavior") == "Removed" and r"[^\s" in first.get("pattern", {}).get("Regex", ""):
        return "drop"
    return "none"


def safe_parts(text: str, size: int = PART_CHARS):
    """Cut one long text before safe blanks into parts of about ``size`` characters."""
    start = 0
    while len(text) - start > size:
        found = SAFE_BLANK.search(text, start + size)
        if not found:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


class Encoder:
    """Encodes Arrow arrays of texts; keeps the ids of frequent pieces."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.kind = boundary_kind(spec)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        marks = [t for t in spec.get("added_tokens", []) if t["special"] and not t["lstrip"] and not t["rstrip"] and not t["single_word"]]
        self.mark, self.mark_id = (marks[0]["content"], marks[0]["id"]) if marks else (None, None)
        self.known: dict[str, int] = {}
        self.used, self.filled = 0, 0
        self.starts = np.zeros(1 << 16, dtype=np.int64)
        self.counts = np.zeros(1 << 16, dtype=np.int64)
        self.ids = np.zeros(1 << 18, dtype=np.uint32)

    # pieces ------------------------------------------------------------
    def _split(self, texts: pa.Array) -> pa.ListArray:
        if self.kind == "drop":
            return pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        if self.kind == "none":
            return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32)), texts)
        from roomtrace.llm.common import text_bytes

        data, offsets = text_bytes(texts)
        odd = _ODD[data]
        blank = (data == 32) | (data == 10)
        odd[:-1] |= blank[:-1] & blank[1:]
        before = np.concatenate([[0], np.cumsum(odd)])
        flagged = before[offsets[1:]] > before[offsets[:-1]]
        if not flagged.any():
            return self._split_plain(texts)
        rows = np.flatnonzero(flagged)
        slow = pa.array([re.split(r"(?<=[!-~\w])(?= [!-~\w])", t) for t in texts.take(pa.array(rows)).to_pylist()], pa.list_(pa.string()))
        both = pa.concat_arrays([self._split_plain(texts.filter(pa.array(~flagged))), slow])
        place = np.empty(len(texts), dtype=np.int64)
        place[~flagged] = np.arange(len(texts) - len(rows))
        place[rows] = np.arange(len(texts) - len(rows), len(texts))
        return both.take(pa.array(place))

    @staticmethod
    def _split_plain(texts: pa.Array) -> pa.ListArray:
        return pc.split_pattern(pc.replace_substring(pc.replace_substring(texts, " ", "\x01 "), "\n", "\x01\n\x01"), "\x01")

    # ids -----------------------------------------------------------------
    def _library(self, pieces: list[str]) -> list[np.ndarray]:
        """Ids of each piece; many go into one call, parted by a special token that the library never merges."""
        encode = lambda batch: self.tokenizer.encode_batch_fast(batch, add_special_tokens=False)
        if self.mark is None:
            return [np.array(e.ids, dtype=np.uint32) for e in encode(pieces)]
        out: list = [None] * len(pieces)
        alone = [i for i, p in enumerate(pieces) if self.mark in p]
        for i, e in zip(alone, encode([pieces[i] for i in alone]) if alone else [], strict=True):
            out[i] = np.array(e.ids, dtype=np.uint32)
        rest = [i for i in range(len(pieces)) if out[i] is None]
        for at in range(0, len(rest), AT_ONCE):
            some = rest[at : at + AT_ONCE]
            ids = np.array(encode([self.mark.join(pieces[i] for i in some)])[0].ids, dtype=np.uint32)
            ends = np.concatenate([np.flatnonzero(ids == self.mark_id), [len(ids)]])
            if len(ends) != len(some):
                raise ValueError("the library did not keep the pieces apart")
            start = 0
            for i, end in zip(some, ends.tolist(), strict=True):
                out[i] = ids[start:end]
                start = end + 1
        return out

    def _places(self, pieces: list[str]) -> np.ndarray:
        """Where the ids of each distinct piece stand; new ones are encoded and, while there is room, remembered."""
        get = self.known.get
        places = np.fromiter((get(p, -1) for p in pieces), dtype=np.int64, count=len(pieces))
        missing = np.flatnonzero(places < 0)
        if len(missing):
            found = self._library([pieces[i] for i in missing.tolist()])
            sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
            need, total = self.used + len(found), self.filled + int(sizes.sum())
            while need > len(self.starts):
                self.starts, self.counts = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.counts, 2 * len(self.counts))
            while total > len(self.ids):
                self.ids = np.resize(self.ids, 2 * len(self.ids))
            self.starts[self.used : need] = self.filled + np.cumsum(sizes) - sizes
            self.counts[self.used : need] = sizes
            self.ids[self.filled : total] = np.concatenate(found)
            places[missing] = np.arange(self.used, need)
            room = max(0, REMEMBERED - self.used)
            for k, i in enumerate(missing[:room].tolist()):
                self.known[pieces[i]] = self.used + k
            keep = min(len(found), room)
            # what is not remembered stands behind the remembered ids and is overwritten by the next batch
            self.used, self.filled = self.used + keep, self.filled + int(sizes[:keep].sum())
        return places

    def _coded(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """For each piece of the texts the place of its ids, and the first piece of each text."""
        pieces = self._split(texts)
        coded = pieces.flatten().dictionary_encode()
        firsts = pieces.offsets.to_numpy().astype(np.int64)
        places = self._places(coded.dictionary.to_pylist())
        return places[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.zeros(0, np.int64), firsts - firsts[0]

    def lengths(self, texts: pa.Array) -> np.ndarray:
        """Number of tokens of each text."""
        places, firsts = self._coded(texts)
        sums = np.concatenate([[0], np.cumsum(self.counts[places])])
        return sums[firsts[1:]] - sums[firsts[:-1]]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text begins (one more entry at the end)."""
        from roomtrace.llm.common import ragged

        places, firsts = self._coded(texts)
        counts = self.counts[places]
        sums = np.concatenate([[0], np.cumsum(counts)])
        return self.ids[ragged(self.starts[places], counts)], sums[firsts]


def parted(texts: pa.Array, limit: int):
    """Rows of about ``limit`` bytes together; of a longer text its parts, one after another.

    Yields (first row, array of texts, True if the array is one part of that single row).
    """
    from roomtrace.llm.common import by_bytes

    for first, some in by_bytes(texts, limit):
        if len(some) == 1 and len(some[0].as_buffer()) > limit:
            for part in safe_parts(some[0].as_py(), limit):
                yield first, pa.array([part], pa.string()), True
        else:
            yield first, some, False


def token_rows(encoder: Encoder, texts: pa.Array, limit: int):
    """(row, its ids) for every row in order, whatever the length of its text."""
    held: list[np.ndarray] = []
    row = -1
    for first, some, part in parted(texts, limit):
        if held and (first != row or not part):
            yield row, np.concatenate(held)
            held = []
        ids, starts = encoder.encode(some)
        if part:
            held.append(ids)
            row = first
        else:
            for k in range(len(some)):
                yield first + k, ids[starts[k] : starts[k + 1]]
    if held:
        yield row, np.concatenate(held)
