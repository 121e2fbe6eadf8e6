"""Approximate nearest neighbours by inner product: NN-descent builds a graph, greedy search reads it.

* Equal vectors are one node; their ids come back in at the end.
* A node's code is its vector in bytes with one scale; it travels where scores are needed.
  Products of codes are exact whole numbers, so a pair has the same score wherever it is
  computed.  The last step scores on the original vectors in double precision.
* The first lists come from blocks of similar nodes: signs of projections, cut at their
  medians, name a block, and every node meets its block.
* NN-descent: each node gets the codes of the nodes that list it and of those it lists
  (nodes listed by very many are thinned out by a hash, as the method samples
  them), and the neighbours of a node that meet there propose each other.  Both ways are joins of the edges with the codes.
* Greedy search: a query's beam expands its best unexpanded nodes by a join with the graph, whose
  rows hold the codes of the neighbours; only scores above the worst of the beam come back.  It ends when
  the whole beam is expanded.
"""

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roomtrace.llm.common import table
from roomtrace.llm.vectors import matrix, usable
from roomtrace.plans.scratch import materialize, scratch_dir

#: Listed neighbours of a node, trees of blocks, nodes in a block.
LISTED, TREES, BLOCK = 24, 8, 2048
#: Rounds of descent go on until a round changes at most this share of all list entries.
SETTLED = 0.02
#: Nodes that meet in one group of a descent; a node with more neighbours has several groups.
MEETING, PROPOSED = 64, 8
#: Width of a query's beam and nodes that it expands at a time.
BEAM, EXPANDED = 256, 64
#: Rows that fix the medians of the projections (a bounded sample; all rows are indexed).
SAMPLE = 4096


def encode(vectors: np.ndarray) -> list[bytes]:
    """Scale and rounded components of each vector."""
    scale = np.maximum(np.abs(vectors).max(axis=1, initial=0), 1e-300) / 127
    codes = np.rint(vectors / scale[:, None]).astype(np.int8)
    return [s.tobytes() + c.tobytes() for s, c in zip(scale, codes, strict=True)]


def decode(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Scales, and components as float32, in which products of up to 1,000 components are exact."""
    raw = np.frombuffer(b"".join(blobs), dtype=np.uint8).reshape(len(blobs), -1)
    return np.ascontiguousarray(raw[:, :8]).view(np.float64)[:, 0], raw[:, 8:].view(np.int8).astype(np.float32)


def products(left: list[bytes], right: list[bytes]) -> np.ndarray:
    s, a = decode(left)
    t, b = decode(right)
    return (a @ b.T).astype(np.float64) * np.multiply.outer(s, t)


def _lists(ids: list, scores: list) -> list[pa.Array]:
    offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32))
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    return [pa.ListArray.from_arrays(offsets, pa.array(join(ids, np.int64))), pa.ListArray.from_arrays(offsets, pa.array(join(scores, np.float64)))]


def _best_of(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest of each row, in any order."""
    return np.argpartition(-scores, min(k, scores.shape[1]) - 1, axis=1)[:, :k]


def nodes_of(held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, code, vector) of distinct vectors that are not zero, and (node, id) of all rows; the node is the smallest id."""
    vector = F.filter("vector", lambda x: x != 0)
    kept = held.filter(F.size(vector) > 0).select("id", F.transform("vector", lambda x: x + F.lit(0.0)).alias("vector"))
    key = F.sha2(F.to_json(F.struct("vector")).cast("binary"), 256)
    keyed = materialize(kept.withColumn("key", key), "keyed")
    firsts = keyed.groupBy("key").agg(F.min("id").alias("node"))
    members = materialize(keyed.select("key", "id").join(firsts, "key").select("node", "id"), "members")

    def add_codes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(encode(matrix(batch.column(1), np.float64)), pa.binary()), batch.column(1)], ["node", "code", "vector"])

    distinct = keyed.join(firsts.select("key", F.col("node").alias("id")), ["key", "id"]).dropDuplicates(["id"])
    nodes = distinct.select(F.col("id").alias("node"), "vector").mapInArrow(add_codes, "node long, code binary, vector array<double>")
    return materialize(nodes, "nodes"), members


def first_lists(nodes: DataFrame, total: int) -> DataFrame:
    """(node, near: array of (minus score, id)) from blocks of about ``BLOCK`` nodes in each tree."""
    bits = max(0, int(np.ceil(np.log2(max(total, 1) / BLOCK))))
    sample = np.array([r["vector"] for r in nodes.orderBy(F.xxhash64("node"), "node").limit(SAMPLE).select("vector").collect()])
    random = np.random.default_rng(5)
    planes = random.normal(size=(TREES, bits, sample.shape[1]))
    cuts = np.median(np.einsum("tbd,nd->tbn", planes, sample), axis=2) if bits else np.zeros((TREES, 0))
    powers = 1 << np.arange(bits)

    def place(batches):
        for batch in batches:
            v = matrix(batch.column(2), np.float64)
            cells = [((v @ planes[t].T > cuts[t]) @ powers if bits else np.zeros(len(v), np.int64)) for t in range(TREES)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.arange(TREES), len(v))), pa.array(np.concatenate(cells).astype(np.int64)), pa.concat_arrays([batch.column(0)] * TREES), pa.concat_arrays([batch.column(1)] * TREES)],
                ["tree", "cell", "node", "code"],
            )

    placed = nodes.mapInArrow(place, "tree long, cell long, node long, code binary")
    # a cell that came out too large is several blocks
    sizes = placed.groupBy("tree", "cell").agg(F.ceil(F.count("*") / (2 * BLOCK)).alias("blocks"))
    placed = placed.join(F.broadcast(sizes) if TREES << bits <= 100_000 else sizes, ["tree", "cell"])
    placed = placed.withColumn("part", F.pmod(F.xxhash64("node", "tree"), F.col("blocks"))).drop("blocks")

    def meet(block: pa.Table) -> pa.Table:
        ids = block["node"].to_numpy()
        blobs = block["code"].to_pylist()
        near, scores = [], []
        if len(ids) > 1:
            for a in range(0, len(ids), 512):
                s = products(blobs[a : a + 512], blobs)
                s[np.arange(len(s)), a + np.arange(len(s))] = -np.inf
                top = _best_of(s, min(LISTED, len(ids) - 1))
                near += list(ids[top])
                scores += list(np.take_along_axis(s, top, axis=1))
        else:
            near, scores = [np.zeros(0, np.int64)], [np.zeros(0)]
        return pa.Table.from_arrays([block["node"].combine_chunks(), *_lists(near, scores)], ["node", "ids", "scores"])

    return placed.groupBy("tree", "cell", "part").applyInArrow(meet, "node long, ids array<long>, scores array<double>")


def as_pairs(found: DataFrame) -> DataFrame:
    return found.select("node", F.zip_with("ids", "scores", lambda i, s: F.struct((-s).alias("minus"), i.alias("id"))).alias("near"))


def best_lists(pairs: DataFrame, k: int = LISTED) -> DataFrame:
    """The k best distinct neighbours of each node."""
    merged = F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list("near")))), 1, k)
    return materialize(pairs.groupBy("node").agg(merged.alias("near")), "lists")


def directed(lists: DataFrame, thin: int) -> tuple[DataFrame, DataFrame]:
    """Edges (node, to) of the lists with the number of lists that hold ``to``, and their reverse, of which a node keeps about ``thin``."""
    edges = lists.select("node", F.explode("near").alias("n")).select("node", F.col("n.id").alias("to"))
    held = edges.groupBy("to").agg(F.count("*").alias("in"))
    edges = materialize(edges.join(held, "to").select("node", "to", "in"), "edges")
    chance = F.pmod(F.xxhash64("node", "to"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    back = edges.filter(chance < F.lit(float(thin)) / F.col("in")).select(F.col("to").alias("node"), F.col("node").alias("to"))
    return edges, back


def descend(lists: DataFrame, nodes: DataFrame) -> DataFrame:
    """One round of NN-descent: neighbours that meet at a node propose each other."""
    edges, back = directed(lists, LISTED)
    forward = edges.select("node", F.col("to").alias("at"), F.pmod(F.xxhash64("node"), F.ceil(F.col("in") / MEETING)).alias("part"))
    guests = forward.unionByName(back.select("node", F.col("to").alias("at"), F.lit(0).cast("long").alias("part"))).distinct()
    worst = lists.select("node", (-F.element_at("near", -1)["minus"]).alias("worst"), (F.size("near") >= LISTED).alias("full"))
    told = guests.join(nodes.select("node", "code").join(worst, "node"), "node")

    def propose(group: pa.Table) -> pa.Table:
        ids = group["node"].to_numpy()
        if len(ids) < 2:
            return pa.Table.from_arrays([pa.array([], pa.int64()), *_lists([], [])], ["node", "ids", "scores"])
        blobs = group["code"].to_pylist()
        s = products(blobs, blobs)
        np.fill_diagonal(s, -np.inf)
        least = np.where(group["full"].to_numpy(), group["worst"].to_numpy(), -np.inf)
        top = _best_of(s, min(PROPOSED, len(ids) - 1))
        values = np.take_along_axis(s, top, axis=1)
        use = values > least[:, None]
        some = np.flatnonzero(use.any(axis=1))
        near, scores = [ids[top[k][use[k]]] for k in some], [values[k][use[k]] for k in some]
        return pa.Table.from_arrays([pa.array(ids[some]), *_lists(near, scores)], ["node", "ids", "scores"])

    found = told.groupBy("at", "part").applyInArrow(propose, "node long, ids array<long>, scores array<double>")
    return best_lists(lists.unionByName(as_pairs(found)))


def changed_share(before: DataFrame, after: DataFrame) -> float:
    """The share of the list entries of ``after`` that are not in ``before``."""
    both = after.select("node", "near").join(before.select("node", F.col("near").alias("old")), "node", "left")
    fresh = F.size(F.array_except("near.id", F.coalesce("old.id", F.array().cast("array<bigint>"))))
    fresh, total = both.agg(F.sum(fresh), F.sum(F.size("near"))).first()
    return fresh / total if total else 0.0


def build_graph(nodes: DataFrame) -> DataFrame:
    """(node, near): each node's list after the blocks and as many rounds of descent as it takes to settle.

    A round only puts better entries in the place of worse ones, so the rounds end.
    """
    lists = best_lists(as_pairs(first_lists(nodes, nodes.count())))
    while True:
        before, lists = lists, descend(lists, nodes)
        if changed_share(before, lists) <= SETTLED:
            return lists


def write_graph(lists: DataFrame, nodes: DataFrame) -> str:
    """The graph as searched, both directions, with the codes of the neighbours; bucketed by node, so that each step of a
    search joins it where it lies.  Returns the name of the table, which the caller drops."""
    edges, back = directed(lists, LISTED)
    both = edges.select("node", "to").unionByName(back).distinct()
    coded = both.join(nodes.select(F.col("node").alias("to"), "code"), "to")
    rows = coded.groupBy("node").agg(F.collect_list(F.struct("to", "code")).alias("n")).select("node", F.col("n.to").alias("ids"), F.col("n.code").alias("codes"))
    spark, name = lists.sparkSession, f"graph_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.repartition(buckets, "node").write.bucketBy(buckets, "node").option("path", scratch_dir(spark, name)).saveAsTable(name)
    return name


def greedy_search(queries: DataFrame, graph: DataFrame, beam: int = BEAM, expanded: int = EXPANDED) -> DataFrame:
    """(query, ids, scores): the beam of each query when all of it has been expanded.

    ``queries`` has (query, code, ids, scores): the code, and where the search begins.
    """

    def merge(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        known = {}
        for r in rows:
            for i, s, d in zip(r["ids"], r["scores"], r["done"] or [False] * len(r["ids"]), strict=True):
                known[i] = (s, d or known.get(i, (0, False))[1])
        best = sorted(known.items(), key=lambda x: (-x[1][0], x[0]))[:beam]
        code = next(r["code"] for r in rows if r["code"] is not None)
        fresh = [i for i, (_, d) in best if not d][:expanded]
        ids, scores, done = [i for i, _ in best], [s for _, (s, _) in best], [d or i in set(fresh) for i, (_, d) in best]
        worst = scores[-1] if len(best) == beam else None
        return pa.table({
            "query": pa.array([rows[0]["query"]], pa.int64()), "code": pa.array([code], pa.binary()), "ids": pa.array([ids], pa.list_(pa.int64())),
            "scores": pa.array([scores], pa.list_(pa.float64())), "done": pa.array([done], pa.list_(pa.bool_())),
            "next": pa.array([fresh], pa.list_(pa.int64())), "worst": pa.array([worst], pa.float64()),
        })

    def expand(batches):
        for batch in batches:
            near, scores = [], []
            columns = [c.to_pylist() for c in batch.columns]
            for code, worst, ids, codes in zip(*columns[1:], strict=True):
                s = products([code], codes)[0]
                ids = np.array(ids, dtype=np.int64)
                use = s > worst if worst is not None else np.ones(len(s), dtype=bool)
                near.append(ids[use])
                scores.append(s[use])
            yield pa.RecordBatch.from_arrays([batch.column(0), *_lists(near, scores)], ["query", "ids", "scores"])

    kind = "query long, code binary, ids array<long>, scores array<double>, done array<boolean>, next array<long>, worst double"
    empty = F.lit(None)
    state = queries.withColumn("done", empty.cast("array<boolean>"))
    while True:
        state = materialize(state.groupBy("query").applyInArrow(merge, kind), "beams")
        if not state.filter(F.size("next") > 0).limit(1).count():
            return state.select("query", "ids", "scores")
        front = state.select("query", "code", "worst", F.explode("next").alias("node"))
        found = front.join(graph, "node").select("query", "code", "worst", "ids", "codes").mapInArrow(expand, "query long, ids array<long>, scores array<double>")
        found = found.filter(F.size("ids") > 0).select("query", empty.cast("binary").alias("code"), "ids", "scores", empty.cast("array<boolean>").alias("done"))
        state = state.select("query", "code", "ids", "scores", "done").unionByName(found)


def nearest(rows: DataFrame, is_query, k: int, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): for each row that meets ``is_query`` (on the column ``id``) about its k nearest other rows.

    Nearness is the inner product in double precision, ties go to the smaller id.  Zero vectors and rows that ``usable`` leaves out
    take no part.  Rows with equal vectors are all found.  A query's own id is no candidate of its own; repeated rows of an id
    are one candidate.  An empty table gives no rows.
    """
    spark = rows.sparkSession
    held = materialize(usable(rows, id_column, vector_column).dropDuplicates(["id"]), "vectors")
    nodes, members = nodes_of(held)
    if nodes.limit(1).count() == 0:
        return spark.createDataFrame([], "query_id long, rank int, id long, score double")
    lists = build_graph(nodes)
    asked = members.filter(is_query).select(F.col("node").alias("query")).distinct()
    start = lists.select(F.col("node").alias("query"), F.col("near.id").alias("ids"), F.transform("near.minus", lambda x: -x).alias("scores"))
    queries = nodes.select(F.col("node").alias("query"), "code").join(asked, "query", "left_semi").join(start, "query")
    name = write_graph(lists, nodes)
    try:
        beams = greedy_search(queries, spark.table(name), max(BEAM, 2 * k))
    finally:
        spark.sql(f"DROP TABLE {name}")

    own = F.array(F.col("query"))  # rows with the query's own vector are its neighbours, too
    candidates = beams.select("query", F.explode(F.array_union(own, "ids")).alias("node"))
    vectors = nodes.select("node", "vector")
    scored = candidates.join(vectors, "node").join(vectors.select(F.col("node").alias("query"), F.col("vector").alias("asked")), "query")
    product = F.aggregate(F.zip_with("vector", "asked", lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)
    scored = scored.select("query", "node", product.alias("score"))
    # at most k + 1 ids of each vector can be reported; they are found without bringing all copies together
    few = members.groupBy("node", F.pmod(F.xxhash64("id"), F.lit(256)).alias("part")).agg(F.slice(F.sort_array(F.collect_list("id")), 1, k + 1).alias("ids"))
    few = few.groupBy("node").agg(F.slice(F.sort_array(F.flatten(F.collect_list("ids"))), 1, k + 1).alias("ids"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    # one more than k for each distinct query vector; then for each query without itself
    ranked = scored.join(few, "node").select("query", "score", F.explode("ids").alias("id")).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k + 1)
    best = ranked.groupBy("query").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), "id"))).alias("best"))
    each = members.filter(is_query).select(F.col("node").alias("query"), F.col("id").alias("query_id")).join(best, "query")
    mine = F.slice(F.filter("best", lambda x: x["id"] != F.col("query_id")), 1, k)
    out = each.select("query_id", F.posexplode(mine).alias("at", "found"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("found.id").alias("id"), (-F.col("found.minus")).alias("score"))


def op5_nearest(spark: SparkSession, sf_dir: str, k: int = 20) -> DataFrame:
    """The k nearest other rows of every twentieth vector, by inner product; zero and unusable vectors take no part."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k).withColumnRenamed("id", "vec_id")
