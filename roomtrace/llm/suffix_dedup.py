"""Repeated passages: bytes covered by a string of ``length`` bytes that also starts in an earlier document.

The strings to compare are all suffixes of the corpus, to a depth of ``length`` bytes.
They are sorted deep-shallow, but only where more than one document can be involved:

0. Of identical documents only the first goes on; the others are removed as a whole.
1. Every window of ``length`` bytes has one anchor, the place with the smallest hash of
   ``K`` bytes inside it.  Of the other bytes of a window at least half stand before its anchor,
   or more than half behind it; an anchor's windows of either kind go by a hash of the anchor with
   these bytes.  Equal windows have equal anchors and are of one kind, so two documents can only
   share a window if they share such a hash.  About one place in 14 is an anchor.
2. Blocks of documents send the sorted hashes of their anchors to buckets and get one bit
   for each back: does another block have it, too?  Anchors of one document only go.
3. For the rest, blocks send each anchor's surroundings: the bytes of all windows that
   own it, equal ones of a block once, with the smallest document id.  A bucket sorts the
   suffixes of all surroundings whose anchor bytes stand in different surroundings:
   multikey quicksort with eight bytes as one key, down to ``SHALLOW`` bytes, and blind
   tries for the groups with a longer common prefix.  Equal suffixes learn the smallest
   document id among them.
4. Blocks get the places back whose window starts in an earlier document, and remove
   what these windows cover.

Anchors in very many surroundings are dealt out by the hash of each whole window
instead, so that no common phrase meets in one task.
"""

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roomtrace.llm.common import by_bytes, plain, ragged, table, text_bytes
from roomtrace.llm.shingles import mixed
from roomtrace.plans.scratch import materialize

#: Bytes of an anchor, and of a block of documents.
K, BLOCK_BYTES = 24, 8 << 20
#: Windows looked at together.
SLICE = 1 << 19
#: Surroundings cut out or hashed together.
ROWS = 1 << 14
#: Bytes of text for each bucket of anchors.
BUCKET_BYTES = 16 << 20
#: Depth of the multikey quicksort; longer common prefixes go to blind tries.
SHALLOW = 32
#: An anchor that stands in more blocks than this share of them, and this many, is dealt out window by window.
COMMON_SHARE, COMMON_LEAST = 0.02, 64

_pack = lambda a: zstandard.ZstdCompressor(level=1).compress(a.tobytes())
_unpack = lambda b, dtype: np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype=dtype)
# nearly ascending numbers, as differences
_pack_steps = lambda a: _pack(np.diff(a, prepend=a.dtype.type(0)))
_unpack_steps = lambda b, dtype: np.cumsum(_unpack(b, dtype), dtype=dtype)


def _words_at(data: np.ndarray, offset: int, n: int) -> np.ndarray:
    """The eight bytes that begin ``offset`` after each of the first n places, as numbers."""
    return np.ndarray((n,), dtype="<u8", buffer=data.data, offset=offset, strides=(1,))


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, copies: np.ndarray) -> tuple[np.ndarray, ...]:
    """(place, hash, first window, last window) of each anchor, once for each kind of its windows; windows are given by their first byte.

    ``data`` is followed by at least 64 more bytes; windows lie inside one document, none in the documents ``copies``.
    """
    sizes = np.diff(offsets)
    sizes[copies] = 0
    begins = offsets[:-1]
    ends = begins + np.maximum(sizes - length + 1, 0)
    parts = []
    # a slice's windows only: the numbers of all windows take eight times the memory of the text
    for a in range(0, max(0, int(offsets[-1]) - length + 1), SLICE):
        docs = slice(np.searchsorted(offsets[1:], a, side="right"), np.searchsorted(begins, a + SLICE))
        low, high = np.maximum(begins[docs], a), np.minimum(ends[docs], a + SLICE)
        some = ragged(low, np.maximum(high - low, 0))
        if len(some):
            parts.append(_slice_anchors(data, some, int(some[0]), int(some[-1]) + 1, length))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else tuple(np.zeros(0, np.int64) for _ in range(4))


def _slice_anchors(data: np.ndarray, windows: np.ndarray, start: int, stop: int, length: int) -> tuple[np.ndarray, ...]:
    """The anchors of windows that begin in start .. stop; they and their hashes depend on nothing but the windows' own bytes."""
    span = length - K + 1
    places = stop - start + span - 1
    with np.errstate(over="ignore"):
        h = np.zeros(places, dtype=np.uint64)
        for j in range(0, K, 8):
            h = (h ^ _words_at(data, start + j, places)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        h = mixed(h)
    lowest, covered = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(places, dtype=np.uint64), 1
    while covered * 2 <= span:
        lowest = np.minimum(lowest[:-covered], lowest[covered:])
        covered *= 2
    if span > covered:
        lowest = np.minimum(lowest[: covered - span], lowest[span - covered :])
    own = (lowest[windows - start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    change = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    last = np.concatenate([change[1:], [len(own)]]) - 1
    place, low, high = own[change], windows[change], windows[last]
    # windows up to this place have so many bytes before the anchor, later ones at least so many behind it
    before = (length - K) // 2
    behind = length - K - before + 1
    turn = place + start - before
    early, late = np.flatnonzero(low <= turn), np.flatnonzero(high > turn)
    with np.errstate(over="ignore"):
        wider = lambda p, q, salt: mixed(h[p] * np.uint64(0x9E3779B97F4A7C15) ^ mixed(h[q] + np.uint64(salt)))
        keys = np.concatenate([wider(place[early], place[early] - before, 1), wider(place[late], place[late] + behind, 2)])
    kind = np.concatenate([early, late])
    first = np.concatenate([low[early], np.maximum(low[late], turn[late] + 1)])
    last = np.concatenate([np.minimum(high[early], turn[early]), high[late]])
    order = np.argsort(first, kind="stable")
    return place[kind][order] + start, keys[order], first[order], last[order]


def _around(data: np.ndarray, length: int) -> np.ndarray:
    """The bytes from ``length - K`` before each place to ``length - K`` behind the ``K`` bytes that begin there, as a view."""
    none = np.zeros(length - K, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([none, data, none]), 2 * length - K)


def _surroundings(around: np.ndarray, place: np.ndarray, low: np.ndarray, high: np.ndarray, length: int) -> np.ndarray:
    """The bytes around each anchor, zero outside its own windows."""
    side, width = length - K, around.shape[1]
    out, column = np.empty((len(place), width), dtype=np.uint8), np.arange(width)
    for a in range(0, len(place), ROWS):
        some = slice(a, a + ROWS)
        first, stop = (low - place)[some] + side, (high - place)[some] + side + length
        out[some] = around[place[some]]
        out[some] *= (column >= first[:, None]) & (column < stop[:, None])
    return out


def _row_hash(rows: np.ndarray, *more: np.ndarray) -> np.ndarray:
    """Two 64-bit hashes of each row of bytes, with one more byte from each of ``more``, as one 16-byte value."""
    own, width = rows.shape[1], rows.shape[1] + len(more)
    out = np.zeros((len(rows), 2), dtype=np.uint64)
    for a in range(0, len(rows), ROWS):
        some = slice(a, a + ROWS)
        wide = np.zeros((len(rows[some]), -(-width // 8) * 8), dtype=np.uint8)
        wide[:, :own] = rows[some]
        for k, x in enumerate(more):
            wide[:, own + k] = x[some]
        words = wide.view("<u8")
        with np.errstate(over="ignore"):
            for c in range(2):
                h = np.full(len(words), 0x1234567 + c, dtype=np.uint64)
                for k in range(words.shape[1]):
                    h = mixed((h ^ words[:, k]) * np.uint64(0x9E3779B97F4A7C15 + 2 * c))
                out[some, c] = h
    return out


def _entry_hash(around: np.ndarray, place: np.ndarray, low: np.ndarray, high: np.ndarray, length: int) -> np.ndarray:
    """Two hashes of the surroundings of each anchor and of which windows own it; the surroundings are not kept."""
    side, out = length - K, [np.zeros((0, 2), np.uint64)]
    for a in range(0, len(place), 8 * ROWS):
        p, x, y = (v[a : a + 8 * ROWS] for v in (place, low, high))
        out.append(_row_hash(_surroundings(around, p, x, y, length), x - p + side, y - p + side))
    return np.concatenate(out)


def _classes(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of two numbers: the number of its class for each row, and one row of each class."""
    order = np.lexsort((keys[:, 1], keys[:, 0]))
    new = np.ones(len(keys), dtype=bool)
    new[1:] = (keys[order][1:] != keys[order][:-1]).any(axis=1)
    label = np.empty(len(keys), dtype=np.int64)
    label[order] = np.cumsum(new) - 1
    return label, order[new]


def blind_trie(strings: list[bytes]) -> list[int]:
    """Classes of equal strings of one length, numbered in ascending order of the strings.

    The trie has one leaf for each class; an inner node knows only the first bit in which its two sides differ.  An
    insertion walks down blindly to some leaf, compares with that one string, and adds a node where the first difference is.
    """
    if len(strings) == 2:
        a, b = strings
        return [0, 0] if a == b else ([0, 1] if a < b else [1, 0])
    numbers = [int.from_bytes(s, "big") for s in strings]
    root: list = [-1, numbers[0], [0]]  # a leaf: [-1, number, members]; an inner node: [bit, side 0, side 1]
    for i in range(1, len(numbers)):
        x, node = numbers[i], root
        while node[0] >= 0:
            node = node[2] if x >> node[0] & 1 else node[1]
        differ = x ^ node[1]
        if not differ:
            node[2].append(i)
            continue
        bit, node = differ.bit_length() - 1, root
        while node[0] > bit:
            node = node[2] if x >> node[0] & 1 else node[1]
        old, leaf = list(node), [-1, x, [i]]
        node[:] = [bit, old, leaf] if x >> bit & 1 else [bit, leaf, old]
    out, stack, number = [0] * len(strings), [root], 0
    while stack:
        node = stack.pop()
        if node[0] >= 0:
            stack += [node[2], node[1]]
        else:
            for i in node[2]:
                out[i] = number
            number += 1
    return out


def deep_shallow(rows: np.ndarray, row: np.ndarray, at: np.ndarray, length: int, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Sort the suffixes (row, at) of ``rows`` to a depth of ``length`` bytes.

    Returns their order, and for each place of that order the number of its class of equal strings.
    """
    flat, width = rows.reshape(-1), rows.shape[1]
    base = row * width + at
    padded = np.concatenate([flat, np.zeros(64, np.uint8)])
    order = np.arange(len(base))
    group = np.zeros(len(base), dtype=np.int64)  # of each place of the order: where its group begins
    active = np.arange(len(base))  # places whose group has more than one suffix
    for depth in range(0, min(shallow, length), 8):
        if not len(active):
            break
        begin = base[order[active]] + depth
        key = _big(padded, begin)
        left = length - depth
        if left < 8:
            key &= ~np.uint64((1 << (8 * (8 - left))) - 1)
        by = np.lexsort((key, group[active]))
        order[active] = order[active][by]
        key, old = key[by], group[active]
        new = np.ones(len(active), dtype=bool)
        new[1:] = (old[1:] != old[:-1]) | (key[1:] != key[:-1])
        firsts = np.flatnonzero(new)
        sizes = np.diff(np.concatenate([firsts, [len(active)]]))
        group[active] = np.repeat(active[firsts], sizes)
        active = active[np.repeat(sizes > 1, sizes)]
    label = group.copy()
    if len(active) and shallow < length:
        begin = base[order[active]] + shallow
        tails = np.lib.stride_tricks.sliding_window_view(padded, length - shallow)[begin]
        raw, step = tails.tobytes(), length - shallow
        old = group[active]
        firsts = np.flatnonzero(np.concatenate([[True], old[1:] != old[:-1]])).tolist() + [len(active)]
        for a, b in zip(firsts, firsts[1:], strict=False):
            classes = blind_trie([raw[k * step : (k + 1) * step] for k in range(a, b)])
            by = sorted(range(b - a), key=classes.__getitem__)
            places = active[a:b]
            order[places] = order[places][by]
            previous = -1
            for k, place in zip(by, places.tolist(), strict=True):
                if classes[k] != previous:
                    start, previous = place, classes[k]
                label[place] = start
    return order, label


def _big(padded: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The eight bytes at each place as one number that sorts as they do."""
    return _words_at(padded, 0, len(padded) - 8)[begin].byteswap()


def earliest(rows: np.ndarray, low: np.ndarray, high: np.ndarray, doc: np.ndarray, length: int) -> np.ndarray:
    """For each window of each entry the smallest document id among all entries with the same window.

    ``rows`` are surroundings, ``low`` .. ``high`` the offsets of their windows in them.  Returned entry by entry.
    """
    side = length - K
    spans = high - low + 1
    label, one = _classes(_row_hash(rows, low, high))
    least = np.full(len(one), np.iinfo(np.int64).max)
    np.minimum.at(least, label, doc)
    # surroundings that are the only ones with their anchor need no sorting: all their windows are the same
    anchor, _ = _classes(_row_hash(rows[one][:, side : side + K]))
    several = np.bincount(anchor)[anchor] > 1
    begins = np.concatenate([[0], np.cumsum(spans[one])])
    found = np.repeat(least, spans[one])
    some = np.flatnonzero(several)
    if len(some):
        counts = spans[one[some]]
        row = np.repeat(np.arange(len(some)), counts)
        at = ragged(low[one[some]], counts)
        order, group = deep_shallow(np.ascontiguousarray(rows[one[some]]), row, at, length)
        owner = least[some][row[order]]
        firsts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        smallest = np.repeat(np.minimum.reduceat(owner, firsts), np.diff(np.concatenate([firsts, [len(group)]])))
        found[(begins[some][row] + at - low[one[some]][row])[order]] = smallest
    return found[ragged(begins[label], spans)]


def _blocks(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Rows of about ``BLOCK_BYTES`` of text: block, ids of the documents, their offsets, their bytes."""

    def pack(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        ids, texts, held = [], [], 0

        def block():
            whole = pa.concat_arrays(texts)
            data, offsets = text_bytes(whole)
            own = np.concatenate(ids)
            return pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([own.tobytes()], pa.binary()), pa.array([_pack(offsets)], pa.binary()), pa.array([_pack(data)], pa.binary())],
                ["block", "ids", "offsets", "data"],
            )

        for batch in batches:
            whole = plain(batch.column(1))
            for first, some in by_bytes(whole, BLOCK_BYTES // 4):
                ids.append(batch.column(0).slice(first, len(some)).to_numpy(zero_copy_only=False).astype(np.int64))
                texts.append(some)
                held += sum(pc.binary_length(some).to_pylist())
                if held >= BLOCK_BYTES:
                    yield block()
                    number, ids, texts, held = number + 1, [], [], 0
        if ids:
            yield block()

    narrow = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text")).filter("id IS NOT NULL")
    return narrow.mapInArrow(pack, "block long, ids binary, offsets binary, data binary")


def _open(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data = np.concatenate([_unpack(row["data"], np.uint8), np.zeros(64, np.uint8)])
    return np.frombuffer(row["ids"], np.int64), _unpack(row["offsets"], np.int64), data, np.array(row.get("copies") or [], dtype=np.int64)


def _copies(blocks: DataFrame) -> DataFrame:
    """(block, copies): the places in a block of documents whose whole text an earlier document has, too."""

    def digests(batches):
        for row in _rows(batches):
            ids, offsets, data, _ = _open(row)
            own = [hashlib.md5(data[a:b]).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ids), row["block"])), pa.array(np.arange(len(ids))), pa.array(ids), pa.array(own, pa.binary())], ["block", "place", "id", "digest"],
            )

    read = materialize(blocks.mapInArrow(digests, "block long, place long, id long, digest binary"), "digests")
    firsts = read.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last").select("digest", "first")
    later = read.join(firsts.hint("merge"), "digest").filter("id > first")
    return later.groupBy("block").agg(F.collect_list("place").alias("copies"))


def _rows(batches):
    for batch in batches:
        for k in range(batch.num_rows):
            yield {n: c[k].as_py() for n, c in zip(batch.schema.names, batch.columns, strict=True)}


def _distinct(hashes: np.ndarray, buckets: int):
    """Distinct hashes of a block in the order of (bucket, hash): bucket of each, hash of each."""
    distinct = np.unique(hashes)
    bucket = (distinct % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return bucket[order], distinct[order]


def _answers(hashes: np.ndarray, states: list[dict], buckets: int) -> np.ndarray:
    """What the buckets answered about the hash of each of a block's anchors."""
    bucket = (hashes % np.uint64(buckets)).astype(np.int64)
    rest = (hashes >> np.uint64(32)).astype(np.uint32)
    state = np.zeros(len(hashes), dtype=np.uint8)
    by_bucket = {s["bucket"]: _unpack(s["state"], np.uint8) for s in states}
    own_bucket, own = _distinct(hashes, buckets)
    own_rest = (own >> np.uint64(32)).astype(np.uint32)
    order = np.lexsort((rest, bucket))
    edges = np.concatenate([[0], np.flatnonzero(np.diff(bucket[order])) + 1, [len(order)]])
    left, right = np.searchsorted(own_bucket, np.arange(buckets)), np.searchsorted(own_bucket, np.arange(buckets), side="right")
    for a, b in zip(edges, edges[1:], strict=False):
        k = int(bucket[order[a]])
        values = np.sort(own_rest[left[k] : right[k]])
        state[order[a:b]] = by_bucket[k][np.searchsorted(values, rest[order[a:b]])]
    return state


def _in_two_documents(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether the hash of each of a block's anchors stands in two documents of the block."""
    order = np.lexsort((doc, hashes))
    firsts = np.flatnonzero(np.concatenate([[True], hashes[order][1:] != hashes[order][:-1]]))
    spread = np.minimum.reduceat(doc[order], firsts) != np.maximum.reduceat(doc[order], firsts)
    out = np.empty(len(hashes), dtype=bool)
    out[order] = np.repeat(spread, np.diff(np.concatenate([firsts, [len(hashes)]])))
    return out


def repeated_spans(docs: DataFrame, length: int = 50, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_bytes, spans, kept): the bytes of each document that repeat an earlier one, as maximal runs, and the rest.

    A byte is removed if a string of ``length`` bytes that covers it also starts in a document with a smaller id.  Texts
    are UTF-8 bytes, null is empty; strings never cross documents.  Rows with the same id are documents of their own, none
    of them earlier than the other; rows with a null id have no order and are left out.  An empty table gives no rows.
    ``length`` is from 32 to 100.  Other columns are not read.
    """
    if not 32 <= length <= 100:
        raise ValueError("length must be from 32 to 100")
    blocks = materialize(_blocks(docs, id_column, text_column), "blocks")
    n_blocks = blocks.count()
    buckets = max(1, n_blocks * BLOCK_BYTES // BUCKET_BYTES)
    common = max(COMMON_LEAST, int(COMMON_SHARE * n_blocks))
    side = length - K

    def send_hashes(batches):
        for row in _rows(batches):
            _, offsets, data, copies = _open(row)
            _, h, _, _ = anchors(data, offsets, length, copies)
            bucket, h = _distinct(h, buckets)
            edges = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]]) if len(bucket) else np.zeros(1, np.int64)
            out = []
            for a, b in zip(edges, edges[1:], strict=False):
                rest = np.sort((h[a:b] >> np.uint64(32)).astype(np.uint32))
                out.append((int(bucket[a]), row["block"], _pack(np.diff(rest, prepend=np.uint32(0)))))
            if out:
                k, b, d = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(b, pa.int64()), pa.array(d, pa.binary())], ["bucket", "block", "hashes"])

    def answer(table_):
        owners, blobs = table_["block"].to_pylist(), table_["hashes"].to_pylist()
        lists = [np.cumsum(_unpack(b, np.uint32), dtype=np.uint32) for b in blobs]
        sizes = [len(x) for x in lists]
        _, inverse, counts = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
        n = counts[inverse]
        state = ((n > 1).astype(np.uint8) + (n > common).astype(np.uint8))
        ends = np.cumsum(sizes)
        packed = [_pack(state[e - s : e]) for s, e in zip(sizes, ends, strict=True)]
        return pa.table({"block": pa.array(owners, pa.int64()), "bucket": table_["bucket"], "state": pa.array(packed, pa.binary())})

    # the blocks are shuffled once: all three joins are on the same key of the same table
    known = blocks.join(materialize(_copies(blocks), "copies").hint("merge"), "block", "left")
    told = known.mapInArrow(send_hashes, "bucket long, block long, hashes binary").groupBy("bucket").applyInArrow(answer, "block long, bucket long, state binary")
    states = told.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", "state"))).alias("states"))

    def send_surroundings(batches):
        for row in _rows(batches):
            ids, offsets, data, copies = _open(row)
            place, h, low, high = anchors(data, offsets, length, copies)
            if not len(place):
                continue
            doc = ids[np.searchsorted(offsets, low, side="right") - 1]
            state = _answers(h, row["states"] or [], buckets)
            keep = (state > 0) | _in_two_documents(h, doc)
            bucket = (h[keep] % np.uint64(buckets)).astype(np.int64)
            place, low, high, doc, state = place[keep], low[keep], high[keep], doc[keep], state[keep]
            del h, keep
            if not len(place):
                continue
            around, wide = _around(data, length), state > 1
            if wide.any():  # one entry for each window
                many = (high - low + 1)[wide]
                single = ragged(low[wide], many)
                cut = lambda x, n=many, w=wide: np.repeat(x[w], n)
                p, d = cut(place), cut(doc)
                dealt = (_entry_hash(around, p, single, single, length)[:, 0] % np.uint64(buckets)).astype(np.int64)
                place, low, high = np.concatenate([place[~wide], p]), np.concatenate([low[~wide], single]), np.concatenate([high[~wide], single])
                doc, bucket = np.concatenate([doc[~wide], d]), np.concatenate([bucket[~wide], dealt])
            # equal surroundings are found by their hashes; only those that are sent are cut out and kept
            label, one = _classes(_entry_hash(around, place, low, high, length))
            first, last = (low - place + side)[one].astype(np.uint8), (high - place + side)[one].astype(np.uint8)
            least = np.full(len(one), np.iinfo(np.int64).max)
            np.minimum.at(least, label, doc)
            # entries in the order of the text, and so are nearly all of their uses
            by = np.argsort(one)
            rank = np.empty(len(one), dtype=np.int64)
            rank[by] = np.arange(len(one))
            label, one, first, last, least = rank[label], one[by], first[by], last[by], least[by]
            entry_bucket = bucket[one]
            order = np.lexsort((low, label, entry_bucket[label]))
            sorted_buckets = entry_bucket[label][order]
            together = np.argsort(entry_bucket, kind="stable")
            found, begins, counts = np.unique(entry_bucket[together], return_index=True, return_counts=True)
            number = np.empty(len(one), dtype=np.int64)
            number[together] = np.arange(len(one)) - np.repeat(begins, counts)
            out = []
            for k, begin, count in zip(found.tolist(), begins.tolist(), counts.tolist(), strict=True):
                mine = together[begin : begin + count]
                uses = order[np.searchsorted(sorted_buckets, k) : np.searchsorted(sorted_buckets, k, side="right")]
                at = one[mine]
                out.append((
                    k, row["block"], _pack(_surroundings(around, place[at], low[at], high[at], length)), _pack(first[mine]), _pack(last[mine]), _pack_steps(least[mine]),
                    _pack_steps(number[label[uses]].astype(np.int32)), _pack(doc[uses] - least[label[uses]]), _pack_steps(low[uses].astype(np.int32)),
                ))
            names = ["bucket", "block", "rows", "first", "last", "least", "use", "doc", "window"]
            columns = [pa.array(c, pa.int64() if k < 2 else pa.binary()) for k, c in enumerate(zip(*out, strict=True))]
            yield pa.RecordBatch.from_arrays(columns, names)

    def sort_bucket(table_):
        parts = table_.to_pylist()
        rows = [_unpack(p.pop("rows"), np.uint8).reshape(-1, K + 2 * side) for p in parts]
        first = np.concatenate([_unpack(p["first"], np.uint8) for p in parts]).astype(np.int64)
        last = np.concatenate([_unpack(p["last"], np.uint8) for p in parts]).astype(np.int64)
        least = np.concatenate([_unpack_steps(p["least"], np.int64) for p in parts])
        sizes = [len(r) for r in rows]
        whole = np.concatenate(rows)
        del rows
        found = earliest(whole, first, last, least, length)
        del whole
        spans = last - first + 1
        begins = np.cumsum(spans) - spans
        out, base = [], 0
        for p, n in zip(parts, sizes, strict=True):
            use = _unpack_steps(p["use"], np.int32) + base
            doc, window = _unpack(p["doc"], np.int64) + least[use], _unpack_steps(p["window"], np.int32).astype(np.int64)
            count = spans[use]
            hit = np.concatenate([[False], found[ragged(begins[use], count)] < np.repeat(doc, count)])
            # runs of windows that follow one another, as places and lengths
            at = np.concatenate([[-2], ragged(window, count)])
            hits = np.flatnonzero(hit)
            new = np.ones(len(hits), dtype=bool)
            new[1:] = at[hits[1:]] != at[hits[:-1]] + 1
            edges = np.flatnonzero(new)
            runs = np.stack([at[hits[edges]], np.diff(np.concatenate([edges, [len(hits)]]))]).astype(np.int32) if len(hits) else np.zeros((2, 0), np.int32)
            out.append((_pack_steps(runs[0]), _pack(runs[1])))
            base += n
        starts, lengths = zip(*out, strict=True)
        return pa.table({"block": table_["block"], "starts": pa.array(starts, pa.binary()), "lengths": pa.array(lengths, pa.binary())})

    asked = known.join(states.hint("merge"), "block", "left")
    sent = asked.mapInArrow(send_surroundings, "bucket long, block long, rows binary, first binary, last binary, least binary, use binary, doc binary, window binary")
    hits = sent.groupBy("bucket").applyInArrow(sort_bucket, "block long, starts binary, lengths binary")
    hits = hits.groupBy("block").agg(F.collect_list(F.struct("starts", "lengths")).alias("hits"))

    def remove(batches):
        for row in _rows(batches):
            ids, offsets, data, copies = _open(row)
            total = int(offsets[-1])
            change = np.zeros(total + 1, dtype=np.int32)
            if row["hits"]:
                starts = np.concatenate([_unpack_steps(x["starts"], np.int32) for x in row["hits"]])
                ends = starts + np.concatenate([_unpack(x["lengths"], np.int32) for x in row["hits"]]) - 1 + length
                np.add.at(change, starts, 1)
                np.add.at(change, ends, -1)
            gone = np.cumsum(change, dtype=np.int32)[:total] > 0
            for k in copies.tolist():
                gone[offsets[k] : offsets[k + 1]] = offsets[k + 1] - offsets[k] >= length
            spans, kept = [], []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                own = gone[a:b]
                edges = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]])))
                spans.append([{"start": s, "end": e} for s, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)])
                kept.append(data[a:b][~own].tobytes())
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.diff(offsets)), pa.array(spans, kind), pa.array(kept, pa.binary())], ["id", "n_bytes", "spans", "kept"])

    out = known.join(hits.hint("merge"), "block", "left").mapInArrow(remove, "id long, n_bytes long, spans array<struct<start: bigint, end: bigint>>, kept binary")
    return out.withColumnRenamed("id", id_column)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that repeat 50 bytes of an earlier one, as counts and a digest of what is kept."""
    found = repeated_spans(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
