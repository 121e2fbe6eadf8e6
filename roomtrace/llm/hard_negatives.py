"""Hard negatives by threshold joins over an inverted index, after the manner of L2AP.

A search asks for the first k rows of a window of scores, lowest score to highest.  It begins with a
threshold just below the top of the window and lowers it until the window is filled or its
foot is reached; each round is a join that finds every row with a score of the threshold or more.

The dimensions are ordered by their energy, the heavy ones first.  By Cauchy and Schwarz the end of a
vector adds at most the product of two norms to a score, so a row leaves out of
the index the dimensions behind the place where its remaining norm is below the
round's smallest threshold over the anchor's norm.  A shard of the index holds the rows of a
block by how much of them is indexed; the posting list of a dimension is then a
run of the first rows.  Anchors go through the posting lists, heaviest first; scores accumulate, and what is left of both
norms prunes pairs.  The few pairs that last are completed from the dimensions left out.

A grid deals blocks of anchors and shards to tasks.  A task keeps its anchors and the first k rows of their windows so far, which
raise an anchor's threshold, and reads its shards as a stream; only the first k of each window leave it.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roomtrace.llm.common import ragged, table
from roomtrace.llm.vectors import as_decimals, as_long, first_k, grid, matrix, meet, numbered, smallest, whole_vectors
from roomtrace.plans.scratch import materialize

SCALE = 256
#: Rows of a shard, anchors of a block, and anchors whose scores accumulate together.
SHARD, BLOCK, TOGETHER = 4096, 512, 64
#: Dimensions of one posting list.
WIDTH = 8
#: How far below the top of a window the threshold lies, round by round, in parts of the window's height.
ROUNDS = (1 / 16, 3 / 8, 1.0)
#: Pairs are followed one by one when fewer than this share are left.
FEW = 1 / 8
#: Relative slack of all bounds, far above what rounding of doubles can do.
SLACK = 1e-9


def packed_rows(held: DataFrame, order: list[int]) -> DataFrame:
    """Blocks of up to ``SHARD`` rows of (id, label, x): their vectors, of the type ``kind``, with the dimensions in the given order."""

    def pack(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, SHARD):
                part = batch.slice(a, SHARD)
                x = smallest(matrix(part.column(2), np.float64)[:, order])
                ids, labels = (part.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
                yield pa.RecordBatch.from_pydict({"ids": [ids.tobytes()], "labels": [labels.tobytes()], "kind": [x.dtype.str], "vectors": [x.tobytes()]})

    return held.mapInArrow(pack, "ids binary, labels binary, kind string, vectors binary")


def remaining_norms(x: np.ndarray) -> np.ndarray:
    """For each row the norm of what follows each posting list's first dimension, and 0 at the end: (rows, lists + 1)."""
    lists = -(-x.shape[1] // WIDTH)
    squares = np.add.reduceat(x * x, np.arange(lists) * WIDTH, axis=1)
    out = np.zeros((len(x), lists + 1))
    out[:, :-1] = np.sqrt(np.cumsum(squares[:, ::-1], axis=1)[:, ::-1])
    return out


def indexed(blocks: DataFrame, dims: int, least: float) -> DataFrame:
    """The inverted index for scores of ``least`` and more times the anchor's norm, a shard for each block.

    ``ends`` says how many rows each posting list has; ``lists`` holds the lists one after another, each with the values
    of all rows of the shard, those in the list first, as numbers of the type ``kind``.
    """
    starts = list(range(0, dims, WIDTH))

    def invert(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                ids, labels, kind, vectors = (c[row].as_py() for c in batch.columns)
                x = np.frombuffer(vectors, dtype=kind).reshape(-1, dims)
                depth = (remaining_norms(x.astype(np.float64))[:, :-1] >= least * (1 - SLACK)).sum(axis=1)
                by_depth = np.argsort(-depth, kind="stable")
                x, depth = x[by_depth], depth[by_depth]
                ends = np.array([(depth > k).sum() for k in range(len(starts))], dtype=np.int64)
                held = [np.frombuffer(b, dtype=np.int64)[by_depth] for b in (ids, labels)]
                lists = b"".join(np.ascontiguousarray(x[:, a : a + WIDTH]).tobytes() for a in starts)
                yield pa.RecordBatch.from_pydict({"ids": [held[0].tobytes()], "labels": [held[1].tobytes()], "kind": [kind], "lists": [lists], "ends": [ends.tobytes()]})

    return blocks.mapInArrow(invert, "ids binary, labels binary, kind string, lists binary, ends binary")


def pairs_above(q: np.ndarray, q_rest: np.ndarray, least: np.ndarray, lists: list[np.ndarray], rest: np.ndarray, ends: np.ndarray):
    """(anchor, row, score) of all pairs of a shard whose score may be ``least`` of the anchor or more.

    Scores are exact where all sums are whole numbers below 2^53, and near elsewhere; no pair that reaches its threshold is lost.
    """
    rows, count = int(ends[0]), len(lists)
    floor = least - SLACK * q_rest[:, 0] * rest[:, 0].max(initial=0.0)
    depth = (np.arange(rows)[:, None] < ends[None, :]).sum(axis=1)  # lists that a row is in
    score = np.zeros((len(q), rows))
    reached, alive, at = np.zeros(rows, np.int64), np.ones((len(q), rows), dtype=bool), 0
    while at < count and ends[at]:
        score[:, : ends[at]] += q[:, at * WIDTH : (at + 1) * WIDTH] @ lists[at][: ends[at]].T
        at += 1
        if 2 * at >= count or at == count or not ends[at]:
            reached = np.minimum(depth, at)
            alive = score + q_rest[:, reached] * rest[np.arange(rows), reached] >= floor[:, None]
            if np.count_nonzero(alive) < FEW * alive.size:
                break
    a, r = np.nonzero(alive)
    s, done = score[a, r], reached[r]
    # the pairs that are left, over the dimensions that did not accumulate
    for k in range(int(done.min(initial=count)), count):
        more = done <= k
        s[more] += np.einsum("ij,ij->i", q[a[more], k * WIDTH : (k + 1) * WIDTH], lists[k][r[more]])
        keep = ~more | (s + q_rest[a, k + 1] * rest[r, k + 1] >= floor[a])
        a, r, s, done = a[keep], r[keep], s[keep], done[keep]
    return a, r, s


def _exact(a: np.ndarray, r: np.ndarray, q: np.ndarray, lists: list[np.ndarray]) -> np.ndarray:
    """The scores of pairs as whole numbers of any size."""
    rows = {i: [int(v) for part in lists for v in part[i]] for i in np.unique(r)}
    anchors = {i: [int(v) for v in q[i]] for i in np.unique(a)}
    out = np.empty(len(a), dtype=object)
    out[:] = [sum(x * y for x, y in zip(anchors[i], rows[j])) for i, j in zip(a, r)]
    return out


#: Scores that are exact as doubles are smaller in size.
WHOLE = 1 << 52


class Windows:
    """The windows of a block of anchors, one anchor after another, and the first ``k`` rows of each among those seen so far.

    ``known`` is the score of a window's last row, or minus infinity as long as it has fewer than k.
    """

    def __init__(self, windows: list[list[tuple]], k: int):
        flat = [(i, *w) for i, own in enumerate(windows) for w in own]
        self.k, self.of = k, np.array([w[0] for w in flat], dtype=np.int64)
        self.names = np.array([w[1] for w in flat], dtype=np.int32)
        self.low = [w[2] for w in flat]
        self.high = [w[3] for w in flat]
        clipped = lambda values, none: np.array([none if v is None else max(-WHOLE, min(WHOLE, v)) for v in values], dtype=np.int64)
        self.low_whole, self.high_whole = clipped(self.low, -WHOLE), clipped(self.high, WHOLE)
        self.known = np.full(len(flat), -np.inf)
        self.window, self.ids, self.scores = (np.zeros(0, np.int64) for _ in range(3))

    def least(self, anchors: int) -> np.ndarray:
        """For each anchor the score below which no row is among the first k of any of its windows."""
        out = np.full(anchors, np.inf)
        np.minimum.at(out, self.of, self.known)
        return np.where(np.isinf(out), -np.inf, out)

    def choose(self, f: int, until: int, a: np.ndarray, r: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(windows, places in r) of the first rows of each window of the anchors ``f`` to ``until``, by score, ties to the smaller id; ``a`` counts from f."""
        first, last = np.searchsorted(self.of, [f, until])
        order = np.lexsort((ids[r], -scores, a)) if scores.dtype != object else np.array(sorted(range(len(a)), key=lambda i: (a[i], -scores[i], ids[r[i]])), dtype=np.int64)
        a, scores, of = a[order], scores[order], self.of[first:last] - f
        if scores.dtype == object:
            begin, end = np.searchsorted(a, of), np.searchsorted(a, of, side="right")
            for n, w in enumerate(range(first, last)):
                down = -scores[begin[n] : end[n]]
                end[n] = begin[n] + (len(down) if self.low[w] is None else int(np.searchsorted(down, -self.low[w], side="right")))
                begin[n] += 0 if self.high[w] is None else int(np.searchsorted(down, -self.high[w], side="left"))
        else:
            # one key that falls with the score within an anchor
            low = np.maximum(self.low_whole[first:last], np.clip(self.known[first:last], -WHOLE, WHOLE).astype(np.int64))
            key = a * (4 * WHOLE) + (WHOLE - scores)
            begin = np.searchsorted(key, of * (4 * WHOLE) + (WHOLE - self.high_whole[first:last]), side="left")
            end = np.searchsorted(key, of * (4 * WHOLE) + (WHOLE - low), side="right")
        counts = np.clip(end - begin, 0, self.k)
        return np.repeat(np.arange(first, last), counts), order[ragged(begin, counts)]

    def add(self, window: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        if len(window):
            window, ids, scores = np.concatenate([self.window, window]), np.concatenate([self.ids, ids]), np.concatenate([self.scores, scores])
            best = first_k(window, ids, scores, self.k)
            self.window, self.ids, self.scores = window[best], ids[best], scores[best]
            counts = np.bincount(self.window, minlength=len(self.of))
            full = counts == self.k
            self.known[full] = self.scores[np.cumsum(counts)[full] - 1].astype(np.float64)


class Anchors:
    """A block of anchors with their windows."""

    def __init__(self, q, ids, labels, x, least, windows: Windows, same: bool):
        self.q, self.ids, self.labels, self.x, self.least, self.windows, self.same = q, ids, labels, x, least, windows, same
        self.rest = remaining_norms(x)

    def meet(self, ids, labels, lists: list[np.ndarray], rest: np.ndarray, ends: np.ndarray) -> None:
        exact = self.rest[:, 0].max() * rest[:, 0].max() < WHOLE
        least, found = np.maximum(self.least, self.windows.least(len(self.q))), []
        for f in range(0, len(self.q), TOGETHER):
            t = slice(f, f + TOGETHER)
            a, r, score = pairs_above(self.x[t], self.rest[t], least[t], lists, rest, ends)
            fits = (ids[r] != self.ids[t][a]) & ((labels[r] == self.labels[t][a]) == self.same)
            a, r = a[fits], r[fits]
            score = score[fits].astype(np.int64) if exact else _exact(a, r, self.x[t], lists)
            w, at = self.windows.choose(f, f + TOGETHER, a, r, score, ids)
            found.append((w, ids[r[at]], score[at]))
        self.windows.add(*(np.concatenate(part) for part in zip(*found)))

    def answer(self) -> pa.RecordBatch:
        w = self.windows
        return pa.RecordBatch.from_arrays([pa.array(self.q[w.of[w.window]]), pa.array(w.names[w.window]), pa.array(w.ids), as_decimals(w.scores)], ["q", "w", "id", "score"])


FIELDS = {"q": "long", "id": "long", "label": "long", "x": "array<double>", "least": "double", "windows": "array<struct<w:int,p:decimal(38,0)>>"}


def _anchor_blocks(live: DataFrame, count: int, order: list[int]) -> DataFrame:
    """Up to ``BLOCK`` anchors a row, every field an array, but for the vectors, which are bytes with the dimensions in the given order; numbered."""
    kinds = {c: f"array<{kind}>" for c, kind in FIELDS.items()} | {"x": "binary"}

    def gather(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                part = batch.slice(a, BLOCK)
                one = pa.array(np.array([0, part.num_rows], dtype=np.int32))
                x = smallest(matrix(part.column("x"), np.float64)[:, order])
                columns = [pa.array([x.tobytes()], pa.binary()) if c == "x" else pa.ListArray.from_arrays(one, part.column(c)) for c in FIELDS]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([x.dtype.str])], [*FIELDS, "kind"])

    blocks = max(1, -(-count // BLOCK))
    few = live.select([F.col(c).cast(kind).alias(c) for c, kind in FIELDS.items()]).repartition(blocks)
    rows = few.mapInArrow(gather, ", ".join(f"{c} {kind}" for c, kind in kinds.items()) + ", kind string")
    return numbered(rows.withColumnsRenamed({c: f"{c}_of" for c in (*FIELDS, "kind")}), blocks)


def _limits(windows: list, low: int, high: int) -> list[list[tuple]]:
    """(name, lowest, highest) of each anchor's windows: whole numbers, None for no limit."""
    span = lambda w: (None, None) if w["p"] is None else (-(-low * int(w["p"]) // 100), high * int(w["p"]) // 100)
    return [[(w["w"], *span(w)) for w in own] for own in windows]


def _one_round(blocks: DataFrame, order: list[int], largest: float, live: DataFrame, part: float, k: int, same: bool, low: int, high: int) -> DataFrame:
    """(q, w, id, score, rank): up to k rows for each window in ``live``, all with the threshold ``part`` of the way down or more.

    ``live`` has (q, id, label, x, norm, windows), the windows an array of (w, p): without p a window has no limits, else it
    reaches from ``low`` to ``high`` hundredths of p.  ``largest`` is the largest norm of a row.
    """
    dims = len(order)
    top = F.col("norm") * largest
    highest = lambda p: F.when(p.isNull(), top).otherwise(F.least(top, p.cast("double") * (high / 100)))
    lowest = lambda p: F.when(p.isNull(), -top).otherwise(F.greatest(-top, p.cast("double") * (low / 100)))
    threshold = F.array_min(F.transform("windows", lambda w: highest(w["p"]) - (highest(w["p"]) - lowest(w["p"])) * part))
    live = materialize(live.withColumn("least", threshold), "live")
    over_norm = F.when(F.col("norm") > 0, F.col("least") / F.col("norm")).otherwise(F.lit(-1.0))
    size = live.agg(F.count("*").alias("n"), F.min(over_norm).alias("least"), F.sum(F.size("windows")).alias("windows")).first()
    # every block of anchors meets every shard: a stated query set against all rows
    shards = max(1, blocks.count())
    down, across = grid(blocks.sparkSession, size["n"], 2 * dims + 16 * k * -(-(size["windows"] or 0) // max(1, size["n"])), shards * SHARD, 2 * dims + 16)
    down, across = min(down, max(1, -(-size["n"] // BLOCK))), min(across, shards)
    index = numbered(indexed(blocks, dims, size["least"]), blocks.rdd.getNumPartitions())
    cells = meet(_anchor_blocks(live, size["n"], order), index, down, across)
    cells = cells.select("cell", "side", *[f"{c}_of" for c in (*FIELDS, "kind")], "ids", "labels", "kind", "lists", "ends")

    def search(batches):
        now, asked = None, []
        for batch in batches:
            for row in range(batch.num_rows):
                cell, side = (batch.column(c)[row].as_py() for c in range(2))
                if cell != now:
                    yield from (block.answer() for block in asked)
                    now, asked = cell, []
                if side == 0:
                    q, ids, labels, x, least, windows, kind = (batch.column(c)[row].as_py() for c in range(2, 9))
                    q, ids, labels = (np.array(v, dtype=np.int64) for v in (q, ids, labels))
                    x = np.frombuffer(x, dtype=kind).reshape(-1, dims).astype(np.float64)
                    asked.append(Anchors(q, ids, labels, x, np.array(least), Windows(_limits(windows, low, high), k), same))
                else:
                    ids, labels, kind, lists, ends = (batch.column(c)[row].as_py() for c in range(9, 14))
                    ids, labels, ends = (np.frombuffer(v, dtype=np.int64) for v in (ids, labels, ends))
                    values, held = np.frombuffer(lists, dtype=kind).astype(np.float64), []
                    for at in range(0, dims, WIDTH):
                        wide = min(WIDTH, dims - at)
                        held.append(values[at * len(ids) : (at + wide) * len(ids)].reshape(len(ids), wide))
                    rest = remaining_norms(np.concatenate(held, axis=1))
                    for block in asked:
                        block.meet(ids, labels, held, rest, ends)
        yield from (block.answer() for block in asked)

    found = cells.mapInArrow(search, "q long, w int, id long, score decimal(38,0)")
    first = Window.partitionBy("q", "w").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)


def search_windows(blocks: DataFrame, order: list[int], largest: float, anchors: DataFrame, windows: DataFrame, k: int, same: bool, low: int = 0, high: int = 100) -> DataFrame:
    """(q, w, id, score, rank): the first k rows of each window (q, w, p), by score and id; ``_one_round`` says what they are.

    ``anchors`` has (q, id, label, x, norm), ``same`` asks for rows of the anchor's label or of another one.
    """
    # all joins are merges: written tables are a fraction of their rows in memory, so what fits a broadcast by size may not fit the driver
    results, live = [], materialize(windows, "windows")
    for number, part in enumerate(ROUNDS):
        if not live.limit(1).count():
            break
        asked = anchors.join(live.groupBy("q").agg(F.collect_list(F.struct("w", "p")).alias("windows")).hint("merge"), "q")
        found = materialize(_one_round(blocks, order, largest, asked, part, k, same, low, high), "found")
        if number + 1 == len(ROUNDS):
            results.append(found)
            break
        # a window is done when its k rows are found: all others above the threshold are behind them
        full = found.filter(F.col("rank") == k).select("q", "w")
        results.append(found.join(full.hint("merge"), ["q", "w"], "left_semi"))
        live = materialize(live.join(full.hint("merge"), ["q", "w"], "left_anti"), "windows")
    if not results:
        return anchors.sparkSession.createDataFrame([], "q long, w int, id long, score decimal(38,0), rank int")
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out


def hard_negatives(
    rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scaled=lambda c: F.floor(c * SCALE),
    id_column: str = "vec_id", label_column: str = "label", vector_column: str = "embedding",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): rows of other labels that score nearly as well.

    A score is the inner product of two vectors whose components ``scaled`` has made whole numbers; it is exact at any
    size, and shown as the nearest long.  An anchor is a row that meets ``is_anchor``, a condition on the column ``id``.  Its positives are
    the first ``positives`` rows of its label, by falling score, ties to the smaller id; for each positive score P >= 0 the
    first ``negatives`` rows of other labels with a score from ``low`` to ``high`` hundredths of P follow (there are none for P < 0).

    Rows with a null id or label, or a vector that ``whole_vectors`` refuses, take no part.  Rows with the anchor's own id are not
    among its candidates; other repeated ids are candidates each, and each row of a repeated anchor id is an anchor.
    Fewer rows than asked for are all returned; an empty table gives no row.  Labels are whole numbers.  Other columns are not read.
    """
    spark = rows.sparkSession
    narrow = rows.select(F.col(id_column).cast("long").alias("id"), F.col(label_column).cast("long").alias("label"), F.col(vector_column).alias("vector"))
    held = materialize(whole_vectors(narrow.filter("id IS NOT NULL AND label IS NOT NULL"), scaled, "vector").select("id", "label", F.col("x").cast("array<double>").alias("x")), "whole")
    energies = {r["at"]: r["e"] for r in held.select(F.posexplode("x").alias("at", "c")).groupBy("at").agg(F.sum(F.col("c") * F.col("c")).alias("e")).collect()}
    if not energies:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    order = sorted(energies, key=lambda at: (-energies[at], at))
    normed = held.withColumn("norm", F.sqrt(F.aggregate("x", F.lit(0.0), lambda total, c: total + c * c)))
    largest = normed.agg(F.max("norm").alias("m")).first()["m"]
    blocks = materialize(packed_rows(held, order), "blocks")
    anchors = materialize(normed.filter(is_anchor).withColumn("q", F.monotonically_increasing_id()), "anchors")

    unlimited = anchors.select("q", F.lit(0).alias("w"), F.lit(None).cast("decimal(38,0)").alias("p"))
    best = materialize(search_windows(blocks, order, largest, anchors, unlimited, positives, True), "positives")
    below = best.filter(F.col("score") >= 0).select("q", F.col("rank").alias("w"), F.col("score").alias("p"))
    found = search_windows(blocks, order, largest, anchors, below, negatives, False, low, high)
    pairs = best.select("q", F.col("rank").alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("p"))
    out = found.join(pairs.hint("merge"), ["q", "w"]).join(anchors.select("q", F.col("id").alias("anchor_id")).hint("merge"), "q")
    return out.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), as_long(F.col("p")).alias("positive_score"), as_long(F.col("score")).alias("negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to 10 hard negatives for each of the 5 positives of every hundredth vec_id; ``hard_negatives`` defines odd rows."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", moved.alias("label"), "embedding")
    return hard_negatives(rows, F.col("id") % 100 == 0)


OP11_SQL = """
WITH held AS (
    SELECT row_number() OVER () AS q, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT a.q, a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score
    FROM held a JOIN held c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id
), positives AS (
    SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) AS w FROM scored WHERE same
), negatives AS (
    SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
           row_number() OVER (PARTITION BY p.q, p.w ORDER BY n.score DESC, n.vec_id) AS rank
    FROM positives p JOIN scored n ON n.q = p.q AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
    WHERE p.w <= 5
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 10
"""
