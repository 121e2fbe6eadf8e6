"""CSV records with quoted line breaks from files that many tasks read.

A text reader cuts files at line ends, but a line end inside quotes ends no record.  Whether a cut lies inside
quotes depends on all that comes before it, so it is found in two passes.  The first one says of each
stretch of a file how it ends if it begins outside quotes and how if inside; along a file these functions
compose, one short row for each stretch.  The second one knows how its stretch begins, and joins lines to
records; a record that goes over a cut is put together from its fragments.
"""

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roomtrace.plans.scratch import materialize

_QUOTED = rb'[^"]*+(?:""[^"]*+)*+"[^,]*+'
_FIELD = rb'(?:"' + _QUOTED + rb'|[^",][^,]*+|)'
#: A line that ends outside quotes, begun outside or inside; a quote opens a field only at its start.
_FROM_OUTSIDE = re.compile(rb"(?s)" + _FIELD + rb"(?:," + _FIELD + rb")*+")
_FROM_INSIDE = re.compile(rb"(?s)" + _QUOTED + rb"(?:," + _FIELD + rb")*+")
#: A record within one stretch, the begin of one that goes on, and what goes on from an earlier stretch.
WHOLE, CONTINUED, BEGUN = 0, 1, 2


def ends_inside(line: bytes, inside: bool) -> bool:
    """Whether a quoted field is open at the end of a line, given whether one is at its beginning."""
    if b'"' not in line:
        return inside
    return (_FROM_INSIDE if inside else _FROM_OUTSIDE).fullmatch(line) is None


def _lines(spark: SparkSession, path) -> DataFrame:
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.col("value").cast("binary").alias("line")
    )


def _stretches(batch: pa.RecordBatch):
    """(file, block, first row, last row + 1) of each stretch in a batch."""
    if not batch.num_rows:
        return
    files, blocks = batch.column(0).dictionary_encode().indices.to_numpy(zero_copy_only=False), batch.column(1).to_numpy()
    cuts = np.flatnonzero((files[1:] != files[:-1]) | (blocks[1:] != blocks[:-1])) + 1
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
        yield batch.column(0)[int(a)].as_py(), int(blocks[a]), int(a), int(b)


def _ends(batches):
    """(file, block, end if begun outside, end if begun inside) of each stretch."""
    here, ends = None, [False, True]

    def row():
        return pa.RecordBatch.from_arrays([pa.array([x]) for x in (*here, *ends)], ["_file", "_block", "from_outside", "from_inside"])

    for batch in batches:
        for file, block, a, b in _stretches(batch):
            if here != (file, block):
                if here:
                    yield row()
                here, ends = (file, block), [False, True]
            part = batch.column(2).slice(a, b - a)
            # lines without a quote leave things as they are
            for line in part.filter(pc.greater_equal(pc.find_substring(part, b'"'), 0)).to_pylist():
                ends = [ends_inside(line, x) for x in ends]
    if here:
        yield row()


def _begun_inside(spark: SparkSession, path) -> DataFrame:
    """(_file, _block) of the stretches that begin inside quotes."""
    ends = _lines(spark, path).mapInArrow(_ends, "_file string, _block long, from_outside boolean, from_inside boolean")
    along = W.partitionBy("_file").orderBy("_block")
    settled = F.when(F.col("from_outside") == F.col("from_inside"), F.col("from_outside"))
    flips = (F.col("from_outside") & ~F.col("from_inside")).cast("int")
    # since the last stretch that ends the same way in either case, only flips count
    ends = ends.withColumn("_settled", settled).withColumn("_since", F.count("_settled").over(along))
    since = W.partitionBy("_file", "_since").orderBy("_block")
    base = F.coalesce(F.first("_settled", ignorenulls=True).over(since), F.lit(False)).cast("int")
    state = ends.withColumn("_ends", F.pmod(base + F.sum(flips).over(since), F.lit(2)) == 1)
    return state.withColumn("_inside", F.lag("_ends").over(along)).where(F.col("_inside")).select("_file", "_block")


def _joined_lines(batches):
    """(file, block, number in the block, kind, record) of each record or fragment, line ends as they were."""
    here, open_, nth, kept, begun, out = None, False, 0, [], True, []

    def piece(kind, number):
        record = b"\n".join(kept)
        if kind == WHOLE:
            record = record.removesuffix(b"\r")
        if record or kind != WHOLE:
            out.append((*here, number, kind, record))

    def flush():
        files, blocks, numbers, kinds, records = zip(*out) if out else ((),) * 5
        out.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(files, pa.string()), pa.array(blocks, pa.int64()), pa.array(numbers, pa.int64()), pa.array(kinds, pa.int32()), pa.array(records, pa.binary())],
            ["_file", "_block", "_nth", "kind", "record"],
        )

    def leave():
        # what is open at the end of a stretch goes on in the next one
        if here and open_:
            piece(BEGUN if begun else CONTINUED, nth if begun else -1)

    for batch in batches:
        insides = batch.column(3)
        for file, block, a, b in _stretches(batch):
            if here != (file, block):
                leave()
                here, nth, kept = (file, block), 0, []
                open_ = insides[a].as_py()
                begun = not open_
            for line in batch.column(2).slice(a, b - a).to_pylist():
                kept.append(line)
                open_ = ends_inside(line, open_)
                if not open_:
                    if begun:
                        number = nth
                        nth += any(x.removesuffix(b"\r") for x in kept)
                        piece(WHOLE, number)
                    else:
                        piece(CONTINUED, -1)
                    kept, begun = [], True
        yield flush()
    leave()
    yield flush()


def read_records(spark: SparkSession, path) -> DataFrame:
    """(_file, _block, _nth, record): every record of the files as text, blank lines left out.

    ``_block`` is where the stretch in which the record begins lies in its file, ``_nth`` the record's number in it, from 0.
    Lines end with \\n or \\r\\n.  The stretches that begin inside quotes are sent to all tasks: at most
    a short row for each input split, some 13 MB for 100 TB.
    """
    inside = materialize(_begun_inside(spark, path), "inside").withColumn("_inside", F.lit(True))
    lines = _lines(spark, path).join(F.broadcast(inside), ["_file", "_block"], "left").select(
        "_file", "_block", "line", F.coalesce("_inside", F.lit(False)).alias("_inside")
    )
    pieces = lines.mapInArrow(_joined_lines, "_file string, _block long, _nth long, kind int, record binary")
    # at most two fragments for each stretch
    fragments = materialize(pieces.where(F.col("kind") != WHOLE), "fragments")
    along = W.partitionBy("_file").orderBy("_block", "kind")
    numbered = fragments.withColumn("_record", F.count(F.when(F.col("kind") == BEGUN, 1)).over(along))
    parts = F.array_sort(F.collect_list(F.struct("_block", "kind", F.col("record").cast("string").alias("text"), "_nth")))
    put_together = numbered.groupBy("_file", "_record").agg(parts.alias("_parts")).select(
        "_file", F.col("_parts")[0]["_block"].alias("_block"), F.col("_parts")[0]["_nth"].alias("_nth"),
        F.regexp_replace(F.array_join(F.transform("_parts", lambda p: p["text"]), "\n"), "\r$", "").alias("record"),
    )
    whole = pieces.where(F.col("kind") == WHOLE).select("_file", "_block", "_nth", F.col("record").cast("string").alias("record"))
    return whole.unionByName(put_together)
