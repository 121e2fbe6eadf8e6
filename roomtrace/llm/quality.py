"""Quality classifier: a convolutional network over bytes, written in numpy.

Learned filters slide over the bytes of the whole document.  Their answers are
max-pooled over overlapping chunks, a second layer reads the pooled answers of each
chunk, its units are max-pooled over all chunks, and one logistic unit turns them
into a probability.  The filters are tables of byte by place, so a convolution is a
sum of table look-ups.

The network is fitted on the driver, on a bounded sample of labelled rows; scoring is
one narrow pass over every row.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roomtrace.llm.common import by_bytes, plain, table, text_bytes

WIDTH, STRIDE, FILTERS, UNITS = 8, 2, 24, 16
#: Answers are pooled over blocks of so many bytes; a chunk is two neighbouring blocks, so chunks overlap by half.
BLOCK = 128
#: Bounds of the sample: labelled rows, and characters of a row (a window at a hashed place of a longer text).
SAMPLE_ROWS, SAMPLE_CHARS = 4096, 8192
#: Bytes scored together, a multiple of a block; a longer document is convolved so many at a time, with the same answers as in one pass.
WINDOW = 1 << 18
STEPS, BATCH = 420, 48


@dataclass
class Network:
    taps: np.ndarray  # (WIDTH, 256, FILTERS)
    bias: np.ndarray
    chunk: np.ndarray  # (FILTERS, UNITS)
    chunk_bias: np.ndarray
    out: np.ndarray  # (UNITS,)
    out_bias: np.ndarray  # (1,)

    def parts(self):
        return [self.taps, self.bias, self.chunk, self.chunk_bias, self.out, self.out_bias]


def fresh(seed: int = 7) -> Network:
    r = np.random.default_rng(seed)
    f = np.float32
    return Network(
        (r.normal(size=(WIDTH, 256, FILTERS)) * 0.25).astype(f), np.zeros(FILTERS, f), (r.normal(size=(FILTERS, UNITS)) * 0.3).astype(f),
        np.full(UNITS, 0.1, f), (r.normal(size=UNITS) * 0.3).astype(f), np.zeros(1, f),
    )


def lay_out(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts one after another, each at the start of a block and followed by at least WIDTH zero bytes; first block of each."""
    sizes = np.diff(offsets)
    blocks = np.maximum(2, -(-(sizes + WIDTH) // BLOCK))
    firsts = np.concatenate([[0], np.cumsum(blocks)])
    padded = np.zeros(firsts[-1] * BLOCK + WIDTH, dtype=np.uint8)
    shift = np.repeat(firsts[:-1] * BLOCK - offsets[:-1], sizes)
    padded[np.arange(offsets[-1] - offsets[0]) + offsets[0] + shift] = data
    return padded, firsts


def pooled(net: Network, padded: np.ndarray) -> np.ndarray:
    """Largest answer of each filter in each block: (blocks, FILTERS)."""
    n = (len(padded) - WIDTH) // STRIDE
    answers = net.taps[0][padded[0 : n * STRIDE : STRIDE]]
    for k in range(1, WIDTH):
        answers += net.taps[k][padded[k : k + n * STRIDE : STRIDE]]
    return answers.reshape(-1, BLOCK // STRIDE, FILTERS).max(axis=1)


def chunk_units(net: Network, blocks: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Largest value of each chunk unit in each document: (documents, UNITS)."""
    units, _ = _chunks(net, blocks, firsts)
    return np.maximum.reduceat(units, firsts[:-1] - np.arange(len(firsts) - 1), axis=0)


def _chunks(net: Network, blocks: np.ndarray, firsts: np.ndarray):
    inside = np.ones(len(blocks), dtype=bool)
    inside[firsts[1:] - 1] = False  # a document's last block begins no chunk
    left = np.flatnonzero(inside)
    seen = np.maximum(np.maximum(blocks[left], blocks[left + 1]) + net.bias, 0)
    return np.maximum(seen @ net.chunk + net.chunk_bias, 0), (left, seen)


def long_units(net: Network, data: np.ndarray) -> np.ndarray:
    """``chunk_units`` of one text, convolved a window at a time.

    A window is read up to the bytes that its last filters reach, and the last block of one begins a chunk with the first of the next.
    """
    end = -(-(len(data) + WIDTH) // BLOCK) * BLOCK
    best, before = None, np.zeros((0, FILTERS), np.float32)
    for a in range(0, end, WINDOW):
        window = np.zeros(min(WINDOW, end - a) + WIDTH, dtype=np.uint8)
        part = data[a : a + len(window)]
        window[: len(part)] = part
        blocks = np.concatenate([before, pooled(net, window)])
        before = blocks[-1:]
        if len(blocks) > 1:
            units = chunk_units(net, blocks, np.array([0, len(blocks)]))
            best = units if best is None else np.maximum(best, units)
    return best


def scores(net: Network, texts: pa.Array) -> np.ndarray:
    """Probability of label 1 for each text, from all of its bytes."""
    out = np.zeros(len(texts))
    for first, some in by_bytes(texts, WINDOW):
        data, offsets = text_bytes(some)
        if len(some) == 1 and len(data) > WINDOW:
            units = long_units(net, data)
        else:
            padded, firsts = lay_out(data, offsets)
            units = chunk_units(net, pooled(net, padded), firsts)
        out[first : first + len(some)] = 1 / (1 + np.exp(-np.clip((units @ net.out + net.out_bias).astype(np.float64), -30, 30)))
    return out


def gradients(net: Network, data: np.ndarray, offsets: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> list[np.ndarray]:
    """Gradients of the weighted log loss; through each maximum they flow to the place that gave it."""
    padded, firsts = lay_out(data, offsets)
    n = (len(padded) - WIDTH) // STRIDE
    answers = net.taps[0][padded[0 : n * STRIDE : STRIDE]]
    for k in range(1, WIDTH):
        answers += net.taps[k][padded[k : k + n * STRIDE : STRIDE]]
    per = BLOCK // STRIDE
    answers = answers.reshape(-1, per, FILTERS)
    place = answers.argmax(axis=1)
    blocks = np.take_along_axis(answers, place[:, None, :], axis=1)[:, 0, :]
    units, (left, seen) = _chunks(net, blocks, firsts)
    starts = firsts[:-1] - np.arange(len(firsts) - 1)
    top = np.empty((len(labels), UNITS), dtype=np.int64)
    for d, (a, b) in enumerate(zip(starts, [*starts[1:], len(units)], strict=True)):
        top[d] = a + units[a:b].argmax(axis=0)
    columns = np.arange(UNITS)
    high = units[top, columns]
    p = 1 / (1 + np.exp(-np.clip(high @ net.out + net.out_bias, -30, 30)))
    d_logit = ((p - labels) * weights / weights.sum()).astype(np.float32)
    d_high = d_logit[:, None] * net.out * (high > 0)
    d_units = np.zeros_like(units)
    np.add.at(d_units, (top, columns[None, :]), d_high)
    live = np.flatnonzero(d_units.any(axis=1))
    d_units, seen, left = d_units[live], seen[live], left[live]
    d_seen = (d_units @ net.chunk.T) * (seen > 0)
    block = np.where(blocks[left] >= blocks[left + 1], left[:, None], left[:, None] + 1)
    at = (block * per + place[block, np.arange(FILTERS)]) * STRIDE
    d_taps = np.zeros_like(net.taps)
    filters = np.broadcast_to(np.arange(FILTERS), at.shape)
    for k in range(WIDTH):
        np.add.at(d_taps[k], (padded[at + k], filters), d_seen)
    return [d_taps, d_seen.sum(axis=0), seen.T @ d_units, d_units.sum(axis=0), high.T @ d_logit, d_logit.sum(keepdims=True)]


def fit(texts: list[str], labels: np.ndarray, steps: int = STEPS, seed: int = 7) -> Network:
    """Adam on shuffled batches, both labels with equal total weight.  Without both labels, a network that scores 0.5 always."""
    net = fresh(seed)
    if len(set(labels.tolist())) < 2:
        net.out[:] = 0
        return net
    r = np.random.default_rng(seed)
    raw = [np.frombuffer(t.encode(), dtype=np.uint8) for t in texts]
    balance = np.where(labels == 1, 0.5 / (labels == 1).sum(), 0.5 / (labels == 0).sum()) * len(labels)
    first, second = [np.zeros_like(p) for p in net.parts()], [np.zeros_like(p) for p in net.parts()]
    order: list[int] = []
    for step in range(1, steps + 1):
        while len(order) < BATCH:
            order += r.permutation(len(raw)).tolist()
        some, order = order[:BATCH], order[BATCH:]
        offsets = np.concatenate([[0], np.cumsum([len(raw[i]) for i in some])])
        found = gradients(net, np.concatenate([raw[i] for i in some]), offsets, labels[some], balance[some])
        rate = 0.01 * min(1, step / 20) * (1 - 0.9 * step / steps)
        for p, g, m, v in zip(net.parts(), found, first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= (rate * ((m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7) + 1e-4 * p)).astype(np.float32)
    return net


def remainder(ident):
    """crc32 of the id as text, modulo 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(ident.cast("string"), F.lit("")).cast("binary")) % 5


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS) -> Network:
    """Fit on at most ``sample_rows`` labelled rows whose id is not held out, chosen by a hash of the id.

    Null labels and null ids are no examples; of several labels of an id the largest counts.  Of a text longer than
    ``sample_chars`` a window at a hashed place is read.
    """
    ident = F.col(id_column)
    known = labels.select(ident.alias("id"), F.col(label_column).cast("int").alias("label")).filter("id IS NOT NULL AND label IS NOT NULL")
    known = known.filter(remainder(F.col("id")) != 0).groupBy("id").agg(F.max("label").alias("label"))
    chosen = known.orderBy(F.xxhash64(F.col("id").cast("string"), F.lit("sample")), "id").limit(sample_rows)
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    spare = F.greatest(F.length(text) - sample_chars, F.lit(0))
    start = F.pmod(F.xxhash64(ident.cast("string"), F.lit("window")), spare + 1).cast("int") + 1
    window = F.substring(text, start, F.lit(sample_chars))
    # at most sample_rows narrow rows are sent out, so the join is a look-up in a bounded table
    rows = docs.select(ident.alias("id"), window.alias("text")).join(F.broadcast(chosen), "id").dropDuplicates(["id"]).collect()
    rows.sort(key=lambda row: str(row["id"]))
    return fit([row["text"] for row in rows], np.array([row["label"] for row in rows], dtype=np.float32))


def score_quality(docs: DataFrame, net: Network, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, score) of every row.  Null texts are scored as empty ones; repeated and null ids keep their rows."""
    kind = docs.schema[id_column].dataType.simpleString()

    def score(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores(net, plain(batch.column(1))))], ["id", "score"])

    narrow = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    return narrow.mapInArrow(score, f"id {kind}, score double").withColumnRenamed("id", id_column)


def keep_good(docs: DataFrame, net: Network, threshold: float = 0.3, text_column: str = "text") -> DataFrame:
    """The rows that score ``threshold`` or more, with their columns as they were; null texts count as empty, repeated rows stay repeated."""

    def keep(batches):
        for batch in batches:
            yield batch.filter(pa.array(scores(net, plain(batch.column(batch.schema.names.index(text_column)))) >= threshold))

    return docs.mapInArrow(keep, docs.schema)


def op9_quality(spark: SparkSession, sf_dir: str, threshold: float = 0.3) -> DataFrame:
    """Score of every document by a network fitted on the labelled rows that are not held out; repeated and null ids keep their rows."""
    docs = table(spark, sf_dir, "documents")
    scored = score_quality(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", (remainder(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
