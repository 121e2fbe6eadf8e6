"""Near-duplicate documents by DartMinHash signatures, banded joining and exact verification.

A document is the weighted set of its word shingles, a shingle's weight being its
number of occurrences; similarity is the weighted Jaccard measure.

1. Hashed darts are thrown into the regions of the weighted elements: each unit of
   weight of an element owns a strip in which darts fall at exponentially distributed
   distances (their ranks).  Every dart names a coordinate, and the earliest dart of
   each coordinate is the signature.  Two documents agree in a coordinate with
   probability equal to their similarity.  Only darts below a rank that fills nearly
   all coordinates are made, so a signature costs about (weight + coordinates) steps.
2. Identical texts are one node.  Nodes that share a band of coordinates are candidates:
   each member of a bucket is compared with its smallest member, which is one pair
   for each member.  Where that leaves a bucket in more than one component, the shingles
   that no other member of such a bucket has are counted: two texts have no more in common than either
   has besides these, so a text with too many of them is settled, without any pair.  Of the
   others, members that share two bands are compared with one of them that a hash draws, one
   pair for each again.  Members that are then still outside the bucket's largest component
   are compared with the members of all other ones whose size, whose shingles that others
   have too, and whose signature of more coordinates, one bit of each, allow the similarity.
3. Candidates are verified exactly on their texts.  Components of verified links are
   found by repeated minimum labels and pointer jumping, all as joins.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roomtrace.llm.common import by_bytes, plain, table
from roomtrace.llm.shingles import mixed, shingle_hashes, weighted
from roomtrace.plans.scratch import materialize

#: One bit of each coordinate of two sets agrees with probability (1 + similarity) / 2.  Pairs of similarity 0.8 stay below
#: the mean number of differences plus so many standard deviations but for one in millions.
DEVIATIONS = 5.0
#: A pair of similarity 0.8 shares none of 32 bands of 5 coordinates with probability (1 - 0.8^5)^32 = 0.000003.
BANDS, ROWS = 32, 5
#: Coordinates of which texts in crowded buckets have a bit each, for the last comparison: 0.8 then stands out from 0.73.
SKETCH = 2048
#: A band is paired with so many that follow it.
REACH = 4
#: What two texts are compared by before their words are.
COMPARED = ("size", "held", "bits")


def dart_signatures(elements: np.ndarray, weights: np.ndarray, starts: np.ndarray, coordinates: int) -> np.ndarray:
    """The earliest dart of every coordinate for each set that is not empty: (sets, coordinates), 0 for empty sets.

    ``weights`` may be any positive numbers; a dart in the last, partial unit of an element counts if it falls inside.
    """
    sets = len(starts) - 1
    out = np.zeros((sets, coordinates), dtype=np.uint64)
    owner = np.repeat(np.arange(sets), np.diff(starts))
    units = np.ceil(weights).astype(np.int64)
    unit_owner = np.repeat(owner, units)
    level = np.arange(units.sum()) - np.repeat(np.cumsum(units) - units, units)
    share = np.minimum(1.0, np.repeat(weights, units) - level)  # how much of the unit belongs to the element
    whole = bool((share == 1.0).all())
    with np.errstate(over="ignore"):
        strip = mixed(np.repeat(elements, units) + level.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    total = np.bincount(owner, weights=weights, minlength=sets)
    expected = coordinates * np.log(coordinates) + 2 * coordinates
    waiting = total > 0
    limit = np.where(waiting, expected / np.maximum(total, 1e-12), 0.0)
    while waiting.any():
        live = np.flatnonzero(waiting[unit_owner])
        rank, dart, own = np.zeros(len(live)), strip[live], unit_owner[live]
        most, part = limit[own], None if whole else share[live]
        ranks, darts, owners = [], [], []
        while len(own):
            with np.errstate(over="ignore"):
                dart = mixed(dart + np.uint64(0xD1B54A32D192ED03))
            rank -= np.log(((dart >> np.uint64(11)).astype(np.float64) + 0.5) * (1 / (1 << 53)))
            below = np.flatnonzero(rank < most)
            rank, dart, own, most = rank[below], dart[below], own[below], most[below]
            if whole:
                # copies of the ranks, as these go on
                ranks.append(rank.copy())
                darts.append(dart)
                owners.append(own)
                continue
            part = part[below]
            with np.errstate(over="ignore"):
                place = mixed(dart ^ np.uint64(0xA0761D6478BD642F))
            inside = (place >> np.uint64(11)).astype(np.float64) * (1 / (1 << 53)) < part
            ranks.append(rank[inside])
            darts.append(dart[inside])
            owners.append(own[inside])
        ranks, darts, owners = np.concatenate(ranks), np.concatenate(darts), np.concatenate(owners)
        with np.errstate(over="ignore"):
            name = mixed(darts + np.uint64(0x2545F4914F6CDD1D))
        slot = owners * coordinates + (name % np.uint64(coordinates)).astype(np.int64)
        earliest = np.full(sets * coordinates, np.inf)
        np.minimum.at(earliest, slot, ranks)
        ready = waiting & np.isfinite(earliest).reshape(sets, coordinates).all(axis=1)
        # of equal ranks the first dart, written last
        use = np.flatnonzero((ranks == earliest[slot]) & ready[owners])[::-1]
        out.reshape(-1)[slot[use]] = name[use]
        waiting &= ~ready
        limit *= 2
    return out


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band of each signature."""
    keys = np.zeros((len(signatures), bands), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for r in range(rows):
            keys = mixed(keys * np.uint64(0x100000001B3) + signatures[:, r::rows][:, :bands])
        return mixed(keys + np.arange(bands, dtype=np.uint64))


def one_bits(signatures: np.ndarray) -> np.ndarray:
    """The highest bit of each coordinate's dart, 64 to a number: (sets, numbers).  The lowest depend on the coordinate."""
    bits = np.packbits((signatures >> np.uint64(63)).astype(np.uint8), axis=1)
    wide = np.zeros((len(bits), -(-bits.shape[1] // 8) * 8), dtype=np.uint8)
    wide[:, : bits.shape[1]] = bits
    return wide.view(np.int64)


def similarity(left: pa.Array, right: pa.Array, words: int) -> np.ndarray:
    """Exact weighted Jaccard similarity of each pair of texts; 0 where neither has words."""
    n = len(left)
    hashes, starts = shingle_hashes(pa.concat_arrays([left, right]), words)
    owner = np.repeat(np.arange(2 * n), np.diff(starts))
    pair, side = owner % n, owner // n
    order = np.lexsort((hashes, pair))
    pair, side, hashes = pair[order], side[order], hashes[order]
    new = np.ones(len(pair), dtype=bool)
    new[1:] = (pair[1:] != pair[:-1]) | (hashes[1:] != hashes[:-1])
    if not len(new):
        return np.zeros(n)
    at = np.flatnonzero(new)
    first = np.add.reduceat(1 - side, at)
    second = np.add.reduceat(side, at)
    both = np.bincount(pair[at], weights=np.minimum(first, second), minlength=n)
    either = np.bincount(pair[at], weights=np.maximum(first, second), minlength=n)
    return np.divide(both, either, out=np.zeros(n), where=either > 0)


def _signed(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """(id, digest of the text, number of shingles, band keys, a bit of each coordinate) of each row."""

    def sign(batches):
        for batch in batches:
            texts = plain(batch.column(1))
            for first, some in by_bytes(texts, 1 << 20):
                hashes, starts = shingle_hashes(some, words)
                elements, weights, begins = weighted(hashes, starts)
                signatures = dart_signatures(elements, weights, begins, bands * rows)
                keys = band_keys(signatures, bands, rows).view(np.int64)
                bits = one_bits(signatures)
                bit_lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * bits.shape[1]), pa.array(bits.reshape(-1)))
                sizes = np.diff(starts)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(np.where(sizes > 0, bands, 0))]).astype(np.int32)), pa.array(keys[sizes > 0].reshape(-1)),
                )
                digests = pa.array([hashlib.md5(s.as_buffer()).digest() for s in some], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(some)), digests, pa.array(sizes), lists, bit_lists], ["id", "digest", "size", "keys", "bits"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(sign, f"id {kind}, digest binary, size long, keys array<long>, bits array<long>")


def _sketched(docs: DataFrame, words: int) -> DataFrame:
    """(id, number of shingles, a bit of each of ``SKETCH`` coordinates) of each row."""

    def sketch(batches):
        for batch in batches:
            texts = plain(batch.column(1))
            for first, some in by_bytes(texts, 1 << 16):
                hashes, starts = shingle_hashes(some, words)
                bits = one_bits(dart_signatures(*weighted(hashes, starts), SKETCH))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * bits.shape[1]), pa.array(bits.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(some)), pa.array(np.diff(starts)), lists], ["id", "size", "bits"])

    return docs.mapInArrow(sketch, f"id {docs.schema['id'].dataType.simpleString()}, size long, bits array<long>")


def _verified(pairs: DataFrame, docs: DataFrame, words: int, least: float) -> DataFrame:
    """The pairs (a, b) whose texts are similar enough."""
    needed = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    texts = materialize(docs.join(needed.hint("merge"), "id").dropDuplicates(["id"]), "texts")
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("left")).hint("merge"), "a")
    both = both.join(texts.select(F.col("id").alias("b"), F.col("text").alias("right")).hint("merge"), "b").select("a", "b", "left", "right")

    def verify(batches):
        for batch in batches:
            left, right = plain(batch.column(2)), plain(batch.column(3))
            for first, some in by_bytes(right, 1 << 20):
                enough = similarity(left.slice(first, len(some)), some, words) >= least
                yield pa.RecordBatch.from_arrays([batch.column(k).slice(first, len(some)).filter(pa.array(enough)) for k in (0, 1)], ["a", "b"])

    kind = pairs.schema["a"].dataType.simpleString()
    return both.mapInArrow(verify, f"a {kind}, b {kind}")


def components(links: DataFrame) -> DataFrame:
    """(id, class) of every node in a link; the class is the smallest id that can be reached.

    Each round a node takes the smallest label among itself and its neighbours, then the label of that label.  A hub's
    neighbours are combined before the shuffle; the number of rounds grows with the logarithm of a chain.
    """
    edges = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialize(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("class")), "labels")
    while True:
        near = edges.join(labels.select(F.col("id").alias("b"), F.col("class").alias("c")), "b").groupBy("a").agg(F.min("c").alias("c"))
        lower = labels.join(near, labels["id"] == near["a"], "left").select("id", F.least("class", "c").alias("new"), F.col("class").alias("old"))
        lower = materialize(lower, "labels")
        jump = lower.select(F.col("id").alias("new"), F.col("new").alias("next"))
        after = materialize(lower.join(jump, "new", "left").select("id", F.least("new", "next").alias("class"), F.col("old")), "labels")
        if not after.filter(F.col("class") != F.col("old")).limit(1).count():
            return after.select("id", "class")
        labels = after.select("id", "class")


def _own_shingles(ids: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """(id, own): how many shingles of each of the texts, repeats counted, none of the other texts has; texts without such are left out."""
    # numbers instead of ids, as a row for each shingle is shuffled
    numbered = materialize(ids.select("id").distinct().withColumn("number", F.monotonically_increasing_id()), "numbered")
    texts = docs.join(numbered.hint("merge"), "id").dropDuplicates(["number"]).select("number", "text")

    def cut(batches):
        for batch in batches:
            for first, some in by_bytes(plain(batch.column(1)), 1 << 18):
                elements, weights, begins = weighted(*shingle_hashes(some, words))
                owners = pa.array(first + np.repeat(np.arange(len(some)), np.diff(begins)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(owners), pa.array(elements.view(np.int64)), pa.array(weights.astype(np.int64))], ["number", "shingle", "weight"])

    rows = texts.mapInArrow(cut, "number long, shingle long, weight long")
    # a shingle that all texts have is one row of each task
    alone = rows.groupBy("shingle").agg(F.count("*").alias("n"), F.min("number").alias("number"), F.min("weight").alias("weight")).filter("n = 1")
    own = alone.groupBy("number").agg(F.sum("weight").alias("own"))
    return numbered.join(own.hint("merge"), "number").select("id", "own")


def _may_be_similar(a: dict[str, Column], b: dict[str, Column], coordinates: int, least: float) -> Column:
    """Whether two texts' sizes, their shingles that others have too, and the bits of their signatures allow the similarity.

    Texts of similarity s have s / (1 + s) of the sum of their sizes in common.
    """
    mean = coordinates * (1 - least) / 2
    most = mean + DEVIATIONS * (mean * (1 + least) / 2) ** 0.5
    differ = sum(F.bit_count(F.get(a["bits"], k).bitwiseXOR(F.get(b["bits"], k))) for k in range(-(-coordinates // 64)))
    sizes = F.least(a["size"], b["size"]) >= F.lit(least) * F.greatest(a["size"], b["size"])
    common = F.least(a["held"], b["held"]) >= F.lit(least / (1 + least) - 1e-9) * (a["size"] + b["size"])
    return sizes & common & (differ <= most)


def _apart(shared: DataFrame, found: DataFrame) -> DataFrame:
    """(key, id, class, main): the members of buckets in more than one component; main is the bucket's largest one."""
    label = F.coalesce(F.col("class"), F.col("id"))
    held = materialize(shared.join(found.hint("merge"), "id", "left").select("key", "id", label.alias("class")), "held")
    counted = held.groupBy("key", "class").agg(F.count("*").alias("n"))
    main = counted.groupBy("key").agg(F.max_by("class", F.struct("n", "class")).alias("main"), F.count("*").alias("classes")).filter("classes > 1")
    return materialize(held.join(main.select("key", "main").hint("merge"), "key"), "apart")


def _drawn_pairs(apart: DataFrame, keyed: DataFrame, bands: int, rows: int, least: float) -> DataFrame:
    """(a, b): members of different components that share two bands, each with one member that a hash draws for these two.

    That is one pair for each member and two bands.  Two texts that are still apart can share only buckets in ``apart``.
    """
    steps = list(range(1, bands))[:REACH] or [0]
    own = apart.groupBy("id").agg(F.collect_list("key").alias("own"), F.first("class").alias("class"))
    two = lambda i, d: F.array(F.get("keys", i), F.get("keys", (i + d) % bands))
    both = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.array(*[two(i, d) for d in steps])))
    held = F.filter(both, lambda x: F.array_contains("own", x[0]) & F.array_contains("own", x[1]))
    members = own.join(keyed.hint("merge"), "id").select("id", "class", "size", "held", "bits", F.explode(F.transform(held, lambda x: F.xxhash64(x[0], x[1]))).alias("two"))
    members = materialize(members, "members")
    hubs = members.groupBy("two").agg(F.min(F.struct(F.xxhash64("id", "two").alias("draw"), "id", "class", "size", "held", "bits")).alias("hub"), F.count("*").alias("n")).filter("n > 1")
    hub = F.col("hub")
    alike = _may_be_similar({k: F.col(k) for k in COMPARED}, {k: hub[k] for k in COMPARED}, bands * rows, least)
    met = members.join(hubs.hint("merge"), "two").filter((F.col("class") != hub["class"]) & alike)
    return met.select(F.least("id", hub["id"]).alias("a"), F.greatest("id", hub["id"]).alias("b")).distinct()


def _text_node(id_column: str, text_column: str) -> Column:
    """What tells texts apart: the id first, so that the smallest node has the smallest id, and a digest, as ids may be repeated."""
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    return F.struct(F.col(id_column).alias("id"), F.unhex(F.md5(text)).alias("digest"))


def text_classes(
    docs: DataFrame, least: float = 0.8, words: int = 5, bands: int = BANDS, rows: int = ROWS, id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """(node, class, links): one row per distinct id and text, the id not null; ``near_duplicates`` says what they are.

    The node is (id, digest of the text), the class the smallest node of its group.
    """
    narrow = docs.filter(F.col(id_column).isNotNull()).select(_text_node(id_column, text_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    signed = materialize(_signed(narrow, words, bands, rows), "signatures")
    nodes = signed.groupBy("digest").agg(F.min("id").alias("node"))
    # joins are by sorting and merging at every size: what is small here grows with the corpus
    copies = materialize(signed.select("id", "digest").join(nodes.hint("merge"), "digest").select("id", "node"), "copies")
    keyed = signed.select("id", "size", "keys", "bits").join(nodes.select(F.col("node").alias("id")).hint("merge"), "id", "left_semi").dropDuplicates(["id"])
    keyed = materialize(keyed, "keyed")
    members = keyed.select("id", F.explode("keys").alias("key"))

    hubs = materialize(members.groupBy("key").agg(F.min("id").alias("hub"), F.count("*").alias("n")).filter("n > 1"), "hubs")
    shared = materialize(members.join(hubs.select("key", "hub").hint("merge"), "key").select("key", "id", "hub").distinct(), "shared")
    stars = materialize(shared.filter("id > hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct(), "pairs")
    links = materialize(_verified(stars, narrow, words, least), "links")
    found = components(links)

    # what the stars left apart meets in pairs of bands, around hubs drawn by a hash: most of a crowd of near copies becomes one component
    apart = _apart(shared.select("key", "id"), found)
    own = _own_shingles(apart, narrow, words)
    held = keyed.join(apart.select("id").distinct().hint("merge"), "id").join(own.hint("merge"), "id", "left").withColumn("held", F.col("size") - F.coalesce("own", F.lit(0)))
    held = materialize(held.filter(F.col("held") >= F.lit(least - 1e-9) * F.col("size")).drop("own"), "held")
    apart = _apart(apart.select("key", "id").join(held.select("id").hint("merge"), "id"), found)
    drawn = materialize(_drawn_pairs(apart, held, bands, rows, least).join(stars.hint("merge"), ["a", "b"], "left_anti"), "pairs")
    links = materialize(links.unionByName(_verified(drawn, narrow, words, least)), "links")

    # buckets that are still in more than one component
    split = _apart(apart.select("key", "id"), components(links))
    members = split.groupBy("id").agg(F.collect_set("key").alias("keys")).join(held.select("id", "held").hint("merge"), "id")
    sketches = _sketched(narrow.join(split.select("id").distinct().hint("merge"), "id", "left_semi").dropDuplicates(["id"]), words)
    sketches = materialize(members.join(sketches.hint("merge"), "id"), "sketches")
    split = materialize(split.join(sketches.hint("merge"), "id"), "split")
    few = split.filter("class <> main").select("key", F.struct("id", "class", "keys", *COMPARED).alias("x"))
    x = F.col("x")
    other = (F.col("class") != x["class"]) & ((F.col("class") == F.col("main")) | (F.col("id") < x["id"]))
    alike = _may_be_similar({k: F.col(k) for k in COMPARED}, {k: x[k] for k in COMPARED}, SKETCH, least)
    # of all buckets that two members share, the first one gives their pair
    once = F.array_min(F.array_intersect("keys", x["keys"])) == F.col("key")
    rest = split.join(few.hint("merge"), "key").filter(other & alike & once).select(F.least("id", x["id"]).alias("a"), F.greatest("id", x["id"]).alias("b")).distinct()
    rest = materialize(rest.join(stars.unionByName(drawn).hint("merge"), ["a", "b"], "left_anti"), "pairs")
    links = materialize(links.unionByName(_verified(rest, narrow, words, least)), "links")

    found = components(links)
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
    out = copies.join(found.withColumnRenamed("id", "node"), "node", "left").join(degree, "node", "left")
    out = out.select("id", F.coalesce("class", "node").alias("class"), F.coalesce("links", F.lit(0).cast("long")).alias("links"))
    return out.dropDuplicates(["id"]).withColumnRenamed("id", "node")


def near_duplicates(
    docs: DataFrame, least: float = 0.8, words: int = 5, bands: int = BANDS, rows: int = ROWS, id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """(id, class, links): one row per distinct id and text, the id not null; the class is the smallest id of its group.

    Identical texts, empty and null ones too (null is empty), are one class.  ``links`` counts the verified links of the
    text to different texts, as far as they were needed to find the classes; copies share the count of their text.  A text of fewer words than a shingle is one shingle; a
    text without words is similar to none but its copies.  Different texts of one id are compared like those of different
    ids; groups that begin with different texts of one id bear the same id.  Rows with a null id have no class and are left
    out.  Other columns are not read.
    """
    found = text_classes(docs, least, words, bands, rows, id_column, text_column)
    return found.select(F.col("node.id").alias(id_column), F.col("class.id").alias("class"), "links")


def keep_one(docs: DataFrame, least: float = 0.8, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of the first text of each class, by id, and rows with a null id, with their columns as they were.

    Of rows with the same kept id and text, one stays; different texts of one id stay if they are not near-duplicates.
    """
    own = "_".join(["node", *docs.columns])
    kept = text_classes(docs, least, id_column=id_column, text_column=text_column).filter(F.col("node") == F.col("class")).select(F.col("node").alias(own))
    with_id = docs.filter(F.col(id_column).isNotNull()).withColumn(own, _text_node(id_column, text_column))
    without = docs.filter(F.col(id_column).isNull())
    return with_id.join(kept, own, "left_semi").dropDuplicates([own]).select(docs.columns).unionByName(without)


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of every document, and how many links of its text were verified on the way to it: evidence, not the number of its near-duplicates."""
    return near_duplicates(table(spark, sf_dir, "documents")).withColumnRenamed("class", "class_id").withColumnRenamed("links", "n_verified")
