"""Best-fit packing of tokenised documents into sequences, by a tree of residual rounds.

Every task tokenises its documents, cuts the long ones and packs its own pieces
best-fit.  Nearly full bins are final.  The underfull ones, now items themselves,
meet in groups of neighbouring tasks, are packed best-fit again, and so on up the
tree.  Only bin fills travel upwards; pieces get their place by one narrow join.
"""

import zlib
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roomtrace.llm.common import kept_in_worker, plain, table
from roomtrace.llm.vocabulary import Encoder, token_rows
from roomtrace.plans.scratch import materialize

#: Pieces that one task packs together; a task with more of them packs several groups.
GROUP_PIECES = 1 << 17
#: Groups that meet in one step up the tree.
FAN_IN = 16
#: A bin filled to this share is final.
NEARLY_FULL = 0.98

_PIECE = "doc {kind}, piece int, start long, length long, ids_crc32 long, group long, bin long, offset long, fill long"


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing.  Returns the bin and the offset of each item, and the fill of each bin.

    Ties go to the earlier item and, among bins with equal room, to the one opened last.  An item as large as the capacity
    gets a bin of its own.
    """
    bins, offsets = np.empty(len(sizes), dtype=np.int64), np.empty(len(sizes), dtype=np.int64)
    fills: list[int] = []
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # open bins by the room they have
    some = 0  # bit r is set where room[r] is not empty
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fitting = some >> size
        if fitting:
            gap = size + (fitting & -fitting).bit_length() - 1
            at = room[gap].pop()
            if not room[gap]:
                some &= ~(1 << gap)
        else:
            gap, at = capacity, len(fills)
            fills.append(0)
        bins[i], offsets[i] = at, fills[at]
        fills[at] += size
        if gap > size:
            room[gap - size].append(at)
            some |= 1 << (gap - size)
    return bins, offsets, np.array(fills, dtype=np.int64)


def cut_ids(ids: np.ndarray, capacity: int) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc32 of the little-endian ids); every piece but the first is full."""
    first = len(ids) % capacity or capacity
    edges = [0, *range(first, len(ids) + 1, capacity)]
    return [(k, a, b - a, zlib.crc32(ids[a:b].astype("<u4").tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]


def _pieces(docs: DataFrame, id_column: str, text_column: str, vocabulary: str, end_id: int, capacity: int) -> DataFrame:
    """All pieces, packed within their task: group, bin, offset in the bin, fill of the bin."""
    kind = docs.schema[id_column].dataType.simpleString()

    def pack(batches):
        from pyspark import TaskContext

        encoder = kept_in_worker(("encoder", vocabulary), lambda: Encoder(vocabulary))
        end = np.array([end_id], dtype=np.uint32)
        ids, rows, groups = [], [], 0

        def packed():
            piece, start, length, crc = (np.array(x, dtype=np.int64) for x in zip(*rows, strict=True))
            bins, offsets, fills = best_fit(length, capacity)
            group = (TaskContext.get().partitionId() << 20) + groups
            flat = [pa.concat_arrays(ids), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc)]
            flat += [pa.array(np.full(len(piece), group)), pa.array((group << 20) + bins), pa.array(offsets), pa.array(fills[bins])]
            return pa.RecordBatch.from_arrays(flat, ["doc", "piece", "start", "length", "ids_crc32", "group", "bin", "offset", "fill"])

        for batch in batches:
            owners: list[int] = []
            for row, tokens in token_rows(encoder, plain(batch.column(1)), 1 << 20):
                found = cut_ids(np.concatenate([tokens, end]), capacity)
                rows += found
                owners += [row] * len(found)
            ids.append(batch.column(0).take(pa.array(owners, pa.int64())))
            if len(rows) >= GROUP_PIECES:
                yield packed()
                ids, rows, groups = [], [], groups + 1
        if rows:
            yield packed()

    narrow = docs.select(F.col(id_column).alias("doc"), F.col(text_column).cast("string").alias("text"))
    return narrow.mapInArrow(pack, _PIECE.format(kind=kind))


def _merge(items: pd.DataFrame, capacity: int, full: int, spare: int) -> pd.DataFrame:
    """One best-fit round over the underfull bins of a few groups.

    After it at most one bin is half empty or more, so each later round can use only a few of the fuller ones:
    ``spare`` of each fill go on, the others are final.
    """
    items = items.sort_values(["fill", "bin"], ascending=[False, True], kind="stable", ignore_index=True)
    at, shift, fills = best_fit(items["fill"].to_numpy(), capacity)
    out = pd.DataFrame({"node": items["node"].iloc[:1].repeat(len(fills)).to_numpy(), "fill": fills})
    out["bin"] = items.groupby(at)["bin"].first().to_numpy()
    members: list = [[] for _ in fills]
    shifts: list = [[] for _ in fills]
    for k, (b, s) in enumerate(zip(at.tolist(), shift.tolist(), strict=True)):
        members[b] += list(items["members"].iat[k])
        shifts[b] += [x + s for x in items["shifts"].iat[k]]
    out["members"], out["shifts"] = members, shifts
    out["final"] = (out["fill"] >= full) | ((out["fill"] > capacity // 2) & (out.groupby("fill").cumcount() >= spare))
    return out


def pack_best_fit(
    docs: DataFrame, vocabulary: str, end_id: int, capacity: int = 1024,
    id_column: str = "doc_id", text_column: str = "text", nearly_full: float = NEARLY_FULL,
) -> DataFrame:
    """One row per piece: (id, piece, start, length, ids_crc32, sequence_id, offset).

    A document is its ids and then ``end_id``; a null or empty text is ``end_id`` alone.  Only documents of more than
    ``capacity`` ids are cut, and then all pieces but the first are full.  Pieces of a sequence follow one another without a
    gap, from offset 0.  Repeated and null ids: each row is a document of its own.  An empty table gives no rows.  Other
    columns are not read.  The packed pieces are written once to the shared folder, so that every round and the last join
    see the same bins whatever is lost and run again.
    """
    full = int(nearly_full * capacity)
    pieces = materialize(_pieces(docs, id_column, text_column, vocabulary, end_id, capacity), "pieces")
    open_bins = pieces.filter((F.col("offset") == 0) & (F.col("fill") < full)).select(
        F.shiftright("group", 20).alias("node"), "bin", "fill", F.array("bin").alias("members"), F.array(F.lit(0).cast("long")).alias("shifts"),
    )
    last = pieces.agg(F.max(F.shiftright("group", 20))).first()[0] or 0
    rounds = 1
    while FAN_IN**rounds <= last:
        rounds += 1
    placed = None
    for left in range(rounds - 1, -1, -1):
        step = partial(_merge, capacity=capacity, full=full, spare=FAN_IN * left)
        up = open_bins.withColumn("node", F.floor(F.col("node") / FAN_IN))
        merged = materialize(
            up.groupBy("node").applyInPandas(step, "node long, fill long, bin long, members array<long>, shifts array<long>, final boolean"),
            "bins",
        )
        done = merged.filter("final") if left else merged
        placed = done if placed is None else placed.unionByName(done)
        open_bins = merged.filter(~F.col("final")).drop("final")
    moves = placed.select(F.col("bin").alias("sequence_id"), F.explode(F.arrays_zip("members", "shifts")).alias("m")).select(
        F.col("m.members").alias("bin"), "sequence_id", F.col("m.shifts").alias("shift"),
    )
    out = ["doc", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    stay = pieces.filter(F.col("fill") >= full).withColumn("sequence_id", F.col("bin")).select(out)
    moved = pieces.filter(F.col("fill") < full).join(moves, "bin").withColumn("offset", F.col("offset") + F.col("shift")).select(out)
    return stay.unionByName(moved).withColumnRenamed("doc", id_column)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in sequences of at most 1024 tokens of the byte-level vocabulary."""
    import public_tokenizers

    return pack_best_fit(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
