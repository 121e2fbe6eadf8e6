"""Lines that many documents share, dropped everywhere but in one document.

1. Each line that counts becomes a row: a hash of its key, its document, its position.
2. The rows are range-partitioned by hash, document (largest first) and position, and sorted
   the same way, so a line that fills many partitions is spread over them.  A task
   streams its rows and holds no more than one document's copies of one line: the first
   document of a hash keeps its lines, from the second on they go as soon as there are enough.
3. Only the first hash of a partition may have begun in another one, and only the last may
   go on.  Their rows are passed on undecided where the partition cannot tell, with the few largest
   documents of each; these summaries, at most ``least_documents`` for two hashes of a partition, decide.
4. What leaves is a compressed bitmap of kept lines for each document that loses some.  Texts are
   not moved before that: they meet their bitmaps once.
"""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roomtrace.llm.common import by_bytes, table
from roomtrace.plans.scratch import materialize

#: Stripped from both ends of a line: \x20 and \x09-\x0D.
BLANKS = b" \t\n\x0b\x0c\r"
LEAST_CHARS, LEAST_DOCUMENTS = 20, 3
#: What a row of the streamed table is.
DROP, UNDECIDED, LARGEST = 0, 1, 2


def line_key(line: bytes) -> bytes:
    """The line without blanks at its ends, A-Z in lower case."""
    return line.strip(BLANKS).lower()


def _code_points(key: bytes) -> int:
    return len(key) if key.isascii() else len(key.decode("utf-8", "replace"))


def _texts(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(doc, text as bytes, mark): rows of one id are told apart by a hash of their text."""
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    return docs.select(F.col(id_column).alias("doc"), text.cast("binary").alias("text"), F.xxhash64(text).alias("mark"))


def _counted_lines(texts: DataFrame, least_chars: int) -> DataFrame:
    """(h1, h2, doc, mark, position) of each line whose key is long enough."""
    kind = texts.schema["doc"].dataType.simpleString()

    def lines(batches):
        for batch in batches:
            for first, some in by_bytes(batch.column(1), 1 << 20):
                owners, places, digests = [], [], []
                for row, text in enumerate(some.to_pylist()):
                    for place, line in enumerate(text.split(b"\n")):
                        if len(line) >= least_chars:
                            key = line_key(line)
                            if len(key) >= least_chars and _code_points(key) >= least_chars:
                                owners.append(row)
                                places.append(place)
                                digests.append(hashlib.blake2b(key, digest_size=16).digest())
                hashes = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
                at = pa.array(np.array(owners, dtype=np.int64) + first)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.ascontiguousarray(hashes[:, 0])), pa.array(np.ascontiguousarray(hashes[:, 1])), batch.column(0).take(at), batch.column(2).take(at), pa.array(np.array(places, dtype=np.int32))],
                    ["h1", "h2", "doc", "mark", "position"],
                )

    return texts.mapInArrow(lines, f"h1 long, h2 long, doc {kind}, mark long, position int")


def _changes(*columns) -> np.ndarray:
    """Whether each row differs from the one before it; the first does."""
    out = np.ones(len(columns[0]), dtype=bool)
    out[1:] = False
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def _streamed(ordered: DataFrame, least_documents: int) -> DataFrame:
    """Decisions over sorted rows: drops, undecided rows, and the largest documents of hashes at a border.

    Of the hash that is open only rows of documents before the ``least_documents``-th are held, until that one comes or the hash ends.
    """
    kind = ordered.schema["doc"].dataType.simpleString()
    names = ["what", "h1", "h2", "doc", "mark", "position"]

    def marked(rows: pa.RecordBatch, what: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(rows.num_rows, what, dtype=np.int32)), *rows.columns], names)

    def decide(batches):
        opening, open_hash, last_doc, rank, kind_of_doc = True, None, None, 0, None
        held: list[pa.RecordBatch] = []  # rows of the open hash that wait for a further document
        firsts: list = []  # its largest documents

        def largest() -> pa.RecordBatch:
            n, (h1, h2) = len(firsts), open_hash
            columns = [pa.array([LARGEST] * n, pa.int32()), pa.array([h1] * n, pa.int64()), pa.array([h2] * n, pa.int64()), pa.array(firsts, kind_of_doc), pa.array([0] * n, pa.int64()), pa.array([0] * n, pa.int32())]
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            if not batch.num_rows:
                continue
            kind_of_doc = batch.column(2).type
            h1, h2 = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            docs = batch.column(2)
            codes = docs.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(_changes(h1, h2))
            ends = np.append(starts[1:], batch.num_rows)
            new_doc = _changes(h1, h2, codes)
            # hashes that begin and end in this batch: all but the first and the last, at once
            if len(starts) > 2:
                ranks = np.cumsum(new_doc)
                ranks -= np.repeat(ranks[starts] - 1, ends - starts)
                gone = (ranks > 1) & np.repeat(ranks[ends - 1] >= least_documents, ends - starts)
                gone[: ends[0]] = gone[starts[-1] :] = False
                inside = batch.filter(pa.array(gone))
            for g in sorted({0, len(starts) - 1}):
                start, stop = int(starts[g]), int(ends[g])
                here = (int(h1[start]), int(h2[start]))
                if here != open_hash:
                    if open_hash is not None and opening:
                        yield largest()
                        opening = False
                    # a hash that ended with too few documents keeps its lines
                    open_hash, last_doc, rank, held, firsts = here, None, 0, [], []
                fresh = new_doc[start:stop].copy()
                fresh[0] = rank == 0 or docs[start].as_py() != last_doc
                here_ranks = rank + np.cumsum(fresh)
                firsts += [docs[start + int(place)].as_py() for place in np.flatnonzero(fresh)[: max(0, least_documents - rank)]]
                rank, last_doc = int(here_ranks[-1]), docs[stop - 1].as_py()
                rows = batch.slice(start, stop - start)
                if opening:  # it may have begun before this partition
                    yield marked(rows, UNDECIDED)
                    continue
                rows = rows.filter(pa.array(here_ranks > 1))
                if rank < least_documents:
                    held.append(rows)
                    continue
                for waiting in [*held, rows]:
                    yield marked(waiting, DROP)
                held = []
            if len(starts) > 2:
                yield marked(inside, DROP)
        if open_hash is not None:  # it may go on behind this partition
            yield largest()
            for waiting in held:
                yield marked(waiting, UNDECIDED)

    return ordered.mapInArrow(decide, f"what int, h1 long, h2 long, doc {kind}, mark long, position int")


def dropped_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_documents: int = LEAST_DOCUMENTS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc, mark, position) of each line that goes."""
    key = ["h1", "h2"]
    counted = materialize(_counted_lines(_texts(docs, id_column, text_column).filter("doc IS NOT NULL"), least_chars), "lines")
    order = [F.col("h1"), F.col("h2"), F.desc("doc"), F.col("mark"), F.col("position")]
    streamed = materialize(_streamed(counted.repartitionByRange(*order).sortWithinPartitions(*order), least_documents), "streamed")
    borders = streamed.filter(F.col("what") == LARGEST).select(*key, "doc").distinct().groupBy(*key)
    # at most two hashes of a partition
    borders = borders.agg(F.max("doc").alias("keeper"), F.count("*").alias("n")).filter(F.col("n") >= least_documents).select(*key, "keeper")
    undecided = streamed.filter(F.col("what") == UNDECIDED).join(F.broadcast(borders), key).filter(F.col("doc") != F.col("keeper"))
    columns = ["doc", "mark", "position"]
    return streamed.filter(F.col("what") == DROP).select(columns).unionByName(undecided.select(columns))


def keep_bitmaps(drops: DataFrame) -> DataFrame:
    """(doc, mark, kept): for each document that loses lines a compressed bitmap, a bit for each line up to the last that goes, filled to whole bytes."""
    kind = drops.schema["doc"].dataType.simpleString()
    grouped = drops.groupBy("doc", "mark").agg(F.collect_list("position").alias("positions"))

    def pack(batches):
        for batch in batches:
            packed = []
            for places in batch.column(2):
                at = places.values.to_numpy(zero_copy_only=False)
                kept = np.ones((int(at.max()) // 8 + 1) * 8, dtype=np.uint8)
                kept[at] = 0
                packed.append(zlib.compress(np.packbits(kept, bitorder="little").tobytes(), 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], ["doc", "mark", "kept"])

    return grouped.mapInArrow(pack, f"doc {kind}, mark long, kept binary")


def kept_lines(text: bytes, bitmap: bytes | None) -> tuple[list[bytes], int]:
    """The lines of a text that stay, and how many there were."""
    lines = text.split(b"\n")
    if bitmap is None:
        return lines, len(lines)
    bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), dtype=np.uint8), bitorder="little")
    # lines behind the bitmap stay
    return [line for k, line in enumerate(lines) if k >= len(bits) or bits[k]], len(lines)


def dedup_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_documents: int = LEAST_DOCUMENTS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_lines, n_dropped, kept text): one row per row of ``docs``.

    A line is what lies between two \\n; null and empty texts are one empty line.  A line whose key (``line_key``) has at least
    ``least_chars`` code points and occurs in at least ``least_documents`` documents goes, except in the one with the largest
    id of these; several copies in one document count once and share its fate.  Rows of one id are one
    document, whose texts are judged each on its own.  A row with a null id is no document: it counts for none and keeps
    all.  Keys are compared by 128-bit hashes.  Other columns are not read.
    """
    texts = _texts(docs, id_column, text_column)
    bitmaps = keep_bitmaps(dropped_lines(docs, least_chars, least_documents, id_column, text_column))
    both = texts.join(bitmaps, ["doc", "mark"], "left").select("doc", "text", "kept")
    kind = texts.schema["doc"].dataType.simpleString()

    def apply(batches):
        for batch in batches:
            for first, some in by_bytes(batch.column(1), 1 << 20):
                maps = batch.column(2).slice(first, len(some)).to_pylist()
                made = [kept_lines(text, bitmap) for text, bitmap in zip(some.to_pylist(), maps)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(some)), pa.array([n for _, n in made], pa.int64()), pa.array([n - len(kept) for kept, n in made], pa.int64()),
                        pa.array([b"\n".join(kept) for kept, _ in made], pa.binary()),
                    ],
                    ["doc", "n_lines", "n_dropped", "kept"],
                )

    return both.mapInArrow(apply, f"doc {kind}, n_lines long, n_dropped long, kept binary")


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of 20 code points and more found in 3 documents and more stay in the largest doc_id only; ``dedup_lines`` defines odd rows."""
    found = dedup_lines(table(spark, sf_dir, "documents"))
    return found.select(F.col("doc").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP12_SQL = """
WITH docs AS (
    SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), lines AS (
    SELECT doc_id, r, unnest(parts) AS line, generate_subscripts(parts, 1) AS place FROM docs
), keyed AS (
    SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), shared AS (
    SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20 AND doc_id IS NOT NULL GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), judged AS (
    SELECT k.doc_id, k.r, k.line, k.place, coalesce(k.doc_id <> s.keeper, false) AS gone FROM keyed k LEFT JOIN shared s ON k.key = s.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count_if(gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY r, doc_id
"""
