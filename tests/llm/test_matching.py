"""Suffix dedup, license scan, near-duplicates, both searches and the pipeline against brute force."""

import hashlib
import random
import re
import time
import tracemalloc
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from roomtrace.llm import licenses, near_dedup, neighbours, shingles, suffix_dedup
from roomtrace.llm.exact_search import exact_top_k, op7_exact_top_k
from roomtrace.llm.queries import SQL
from tests.llm.test_texts import check_packing, empty_docs, odd_docs


def brute_spans(rows, length=50):
    first = {}
    for i, t in sorted((i, t or "") for i, t in rows):
        b = t.encode()
        for p in range(len(b) - length + 1):
            first.setdefault(b[p : p + length], i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out)


def digest(found):
    return sorted((r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in found.collect())


@pytest.mark.parametrize("seed, common", [(1, 64), (2, 1)])
def test_suffix_dedup_of_small_texts(spark, monkeypatch, seed, common):
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 2000)
    monkeypatch.setattr(suffix_dedup, "COMMON_LEAST", common)
    r = random.Random(seed)
    phrases = ["".join(r.choice("ab ") for _ in range(60)) for _ in range(5)] + ["a" * 70, "abc" * 25, "xyz", "", "é" * 30]
    rows = [(i // 2 if i > 50 else i, "".join(r.choice(phrases) for _ in range(r.randrange(6)))) for i in range(60)] + [(90, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert digest(suffix_dedup.repeated_spans(docs)) == brute_spans(rows)


def test_suffix_dedup_of_odd_rows(spark):
    rows = [(r.doc_id, r.text) for r in odd_docs(spark).collect() if r.doc_id is not None]
    assert digest(suffix_dedup.repeated_spans(odd_docs(spark))) == brute_spans(rows)
    assert suffix_dedup.repeated_spans(empty_docs(spark)).count() == 0


def test_suffix_dedup_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in suffix_dedup.op1_suffix_dedup(spark, sf_dir).collect()) == brute_spans(rows)


def test_anchors_take_little_memory_beside_their_text():
    rng = np.random.default_rng(8)
    data = np.concatenate([rng.integers(97, 123, 8 << 20, dtype=np.uint8), np.zeros(64, np.uint8)])
    offsets = np.array([0, 3 << 20, 3 << 20, (3 << 20) + 20, 8 << 20])
    tracemalloc.start()
    place, _, low, high = suffix_dedup.anchors(data, offsets, 50, np.zeros(0, np.int64))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # every window has one anchor, in whichever slice of the text it begins; those of the short document have none
    windows = np.concatenate([np.arange(a, b - 49) for a, b in [(0, 3 << 20), ((3 << 20) + 20, 8 << 20)]])
    assert (suffix_dedup.ragged(low, high - low + 1) == windows).all() and ((place >= low) & (place + suffix_dedup.K <= high + 50)).all()
    # twice the anchors, and a slice
    assert most < 2 * 4 * place.nbytes + 40 * suffix_dedup.SLICE * 2


def test_surroundings_hold_the_windows_of_their_anchor_only():
    rng = np.random.default_rng(9)
    data = np.concatenate([rng.integers(1, 255, 90_000, dtype=np.uint8), np.zeros(64, np.uint8)])
    place, _, low, high = suffix_dedup.anchors(data, np.array([0, 90_000]), 50, np.zeros(0, np.int64))
    around, side = suffix_dedup._around(data, 50), 50 - suffix_dedup.K
    rows = suffix_dedup._surroundings(around, place, low, high, 50)
    for p, a, b, row in [(place[k], low[k], high[k], rows[k]) for k in (0, 1, len(place) // 2, len(place) - 1)]:
        assert bytes(row) == bytes(a - p + side) + bytes(data[a : b + 50]) + bytes(p + suffix_dedup.K + side - b - 50)
    whole = suffix_dedup._row_hash(rows, low - place + side, high - place + side)
    assert (suffix_dedup._entry_hash(around, place, low, high, 50) == whole).all()


def test_deep_shallow_sorts():
    r = np.random.default_rng(5)
    rows = r.choice(np.frombuffer(b"ab", np.uint8), size=(40, 76))
    rows[10:20] = rows[0]
    rows[15:20, 60] ^= 1
    row, at = np.repeat(np.arange(40), 27), np.tile(np.arange(27), 40)
    order, group = suffix_dedup.deep_shallow(rows, row, at, 50)
    strings = [rows[a, b : b + 50].tobytes() for a, b in zip(row, at, strict=True)]
    got = [strings[k] for k in order]
    assert got == sorted(strings)
    assert all((got[k] == got[k - 1]) == (group[k] == group[k - 1]) for k in range(1, len(got)))


def test_blind_trie():
    r = random.Random(3)
    for _ in range(50):
        strings = [bytes(r.choice(b"ab") for _ in range(4)) for _ in range(r.randrange(2, 12))]
        ranks = {s: k for k, s in enumerate(sorted(set(strings)))}
        assert suffix_dedup.blind_trie(strings) == [ranks[s] for s in strings]


def test_license_scan_of_odd_rows(spark):
    assert licenses.scan_licenses(odd_docs(spark)).count() == 0
    assert licenses.scan_licenses(empty_docs(spark)).count() == 0
    texts = [(1, "a b c\nRELEASED under\n the mit--license. d e"), (2, "Released under the license"), (3, None), (None, licenses.TEMPLATES["MIT"]), (4, "x " * 200_000 + licenses.TEMPLATES["GPL-3.0"] + " y" * 10), (5, licenses.TEMPLATES["BSD"] + " and more"), (5, licenses.TEMPLATES["BSD"])]
    found = licenses.scan_licenses(spark.createDataFrame(texts, "doc_id long, text string"))
    assert sorted((str(r.doc_id), r.license) for r in found.collect()) == [("1", "MIT"), ("4", "GPL-3.0"), ("5", "BSD"), ("None", "MIT")]
    assert licenses.scan_licenses(spark.createDataFrame(texts, "doc_id long, text string"), {"none": "..."}).count() == 0


def test_every_template_finds_itself_behind_any_number_of_words(spark):
    rows = [(k * 100 + n, f"{'w ' * n}{t} end") for k, t in enumerate(licenses.TEMPLATES.values()) for n in range(9)]
    found = {(r.doc_id // 100, r.license) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.containment == 1.0}
    assert all((k, name) in found for k, name in enumerate(licenses.TEMPLATES))


def split_copies():
    """Texts of many short passages whose copies, whole, cut, edited or embedded in other words, lie anywhere."""
    r = random.Random(5)
    filler = lambda n: " ".join(r.choice(("amber", "Bronze", "c4", "--", "d\n", "éta", "Σ")) for _ in range(n))
    gpl, bsd, isc = (licenses.TEMPLATES[k].split() for k in ("GPL-notice", "BSD", "ISC"))
    edited = [bsd[:k] + ["other"] + bsd[k + 1 :] for k in (4, 9, 14, 18)]
    rows = [
        " ".join([filler(900), *gpl[:20], filler(1200), *gpl[16:], filler(500)]),
        " ".join([*isc[:12], filler(2500), *isc[8:]]),
        " ".join([*isc[:9], filler(2500), *isc[14:]]),
        " ".join(f"{filler(1000)} {' '.join(e)}" for e in edited),
        "xreleased under the mit licenses " * 1100,
        " ".join([filler(800), "Released under", "-" * 6000, "the MIT\n\nLicense", filler(800)]),
        " ".join([filler(1000), "x" * 9000, licenses.TEMPLATES["CC0"], "y" * 9000]),
    ]
    return rows + [f"{filler(n)} {t} {filler(1500)}" for n, t in zip(range(300, 2000, 100), licenses.TEMPLATES.values(), strict=False)]


def test_license_scan_is_its_sql_when_copies_are_split_between_passages(spark, sf_dir, tmp_path, monkeypatch):
    monkeypatch.setattr(licenses, "PASSAGE", 997)
    given = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = list(enumerate([*split_copies(), *given]))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.execute(f"SELECT doc_id, license, n_shingles, n_found, containment FROM ({SQL['op4_license_scan']})").fetchall())
    assert {(0, "GPL-notice"), (1, "ISC"), (3, "BSD"), (5, "MIT"), (6, "CC0")} <= {x[:2] for x in want} and not {2, 4} & {x[0] for x in want}
    assert sorted(tuple(r) for r in licenses.op4_license_scan(spark, str(tmp_path)).collect()) == want
    monkeypatch.setattr(licenses, "SMALL_INDEX", 0)
    assert sorted(tuple(r) for r in licenses.op4_license_scan(spark, str(tmp_path)).collect()) == want


def test_long_templates_alone_are_found_in_short_texts_and_at_the_end(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    templates = {"BSD": licenses.TEMPLATES["BSD"], "sixteen": " ".join(word() for _ in range(20))}
    bsd = templates["BSD"].split()
    assert len(bsd) == 21  # 17 shingles, of which 18 words in a row hold 14
    rows = [(k, " ".join(bsd[k : k + 18])) for k in range(4)] + [(10 + n, f"{' '.join(word() for _ in range(n))} {templates['sixteen']}") for n in range(40)]
    found = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), templates).collect()
    want = {(k, "BSD", 17, 14) for k in range(4)} | {(10 + n, "sixteen", 16, 16) for n in range(40)}
    assert {(x.doc_id, x.license, x.n_shingles, x.n_found) for x in found} == want and len(found) == len(want)


def test_windows_retrieve_shingles_that_stand_alone(spark):
    """Shingles of a template in any order, each among other words, are found as the SQL form finds them."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    templates = {f"t{n}": [word() for _ in range(n + 4)] for n in (1, 2, 3, 4, 5, 8, 30)}
    rows = []
    for name, words in templates.items():
        for _ in range(40):
            pieces = [words[i : i + 5] for i in range(len(words) - 4)]
            r.shuffle(pieces)
            rows.append((len(rows), name, " ".join(" ".join([*p, word(), word()]) for p in pieces)))
    docs = spark.createDataFrame(rows, "doc_id long, name string, text string")
    found = {(x.doc_id, x.license) for x in licenses.scan_licenses(docs, {k: " ".join(w) for k, w in templates.items()}).collect()}
    assert found == {(i, name) for i, name, _ in rows}


def test_window_keys_are_minima_of_windows_that_hold_a_place(spark):
    runs = [5, -7, 12, 3, 99, -50]
    row = spark.createDataFrame([(runs, [2])], "runs array<long>, places array<int>")
    hashed = {(r.x, r.band): r.h for r in spark.createDataFrame([(x, b) for x in runs for b in range(licenses.BANDS)], "x long, band int").withColumn("h", F.xxhash64("x", "band")).collect()}
    for n in licenses.LENGTHS:
        windows = [runs[i : i + n] for i in range(len(runs) - n + 1) if i <= 2 < i + n]
        want = {min(hashed[x, b] for x in w) for w in windows for b in range(licenses.BANDS)} if n > 1 else {12}
        assert set(row.select(licenses.window_keys("runs", "places", [n])).first()[0]) == want


def words_of(text):
    words = re.findall(r"\w+", (text or "").lower())
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def brute_classes(rows, least=0.8):
    bags = [words_of(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            either = (bags[i] | bags[j]).total()
            if (rows[i][1] or "") == (rows[j][1] or "") or either and (bags[i] & bags[j]).total() >= least * either:
                parent[root(i)] = root(j)
    smallest = {}
    for k, (i, _) in enumerate(rows):
        smallest[root(k)] = min(i, smallest.get(root(k), i))
    return {i: smallest[root(k)] for k, (i, _) in enumerate(rows)}


def test_near_duplicates_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert {r.doc_id: r.class_id for r in near_dedup.op8_near_duplicates(spark, sf_dir).collect()} == brute_classes(rows)


def test_near_duplicates_in_chains_and_crowded_buckets(spark):
    """Chains whose ends are not similar, and texts that share much but not enough."""
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    base = [word() for _ in range(120)]
    rows, chain = [], list(base)
    for _ in range(25):
        chain[r.randrange(120)] = word()
        rows.append(" ".join(chain))
    passage = " ".join(word() for _ in range(60))
    rows += [passage + " " + " ".join(word() for _ in range(n)) for n in (4, 5, 6, 30, 40, 50, 60, 70)]
    rows += [rows[3], rows[3], None, "", "!!", "one two", "one two three"]
    r.shuffle(rows)
    rows = list(enumerate(rows))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x.doc_id: x["class"] for x in near_dedup.near_duplicates(docs).collect()} == brute_classes(rows)
    # narrow bands put many texts that are not similar into one bucket, which the hubs alone would not settle
    assert {x.doc_id: x["class"] for x in near_dedup.near_duplicates(docs, bands=24, rows=1).collect()} == brute_classes(rows)


def test_different_texts_of_one_id_are_all_compared(spark):
    r = random.Random(11)
    text = lambda n=60: " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    a, b, c, d = text(), text(), text(), text()
    # id 1 has three texts, of which one has a near copy at 2 and one an exact copy at 3; of d the first id is 4
    rows = [(1, a), (1, b), (1, c), (1, c), (2, b + " more"), (3, a), (4, d), (5, d + " more"), (5, text()), (None, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = near_dedup.near_duplicates(docs).collect()
    assert sorted((x.doc_id, x["class"]) for x in found) == [(1, 1), (1, 1), (1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (5, 5)]
    kept = near_dedup.keep_one(docs)
    assert kept.schema == docs.schema
    assert sorted((x.doc_id or 0, x.text) for x in kept.collect()) == sorted([(1, a), (1, b), (1, c), (4, d), (5, rows[8][1]), (0, a)])


def test_links_of_the_query_are_named_as_verified_evidence(spark, tmp_path):
    words = [f"w{k}" for k in range(80)]
    rows = [(k, " ".join([*words, f"end{k}"])) for k in range(6)] + [(9, "alone here")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = near_dedup.op8_near_duplicates(spark, str(tmp_path))
    assert found.columns == ["doc_id", "class_id", "n_verified"]
    got = {r.doc_id: (r.class_id, r.n_verified) for r in found.collect()}
    assert got[9] == (9, 0) and all(got[k][0] == 0 and 1 <= got[k][1] <= 5 for k in range(6))


def test_near_duplicates_of_odd_rows(spark):
    found = {r.doc_id: (r["class"], r.links) for r in near_dedup.near_duplicates(odd_docs(spark)).collect()}
    assert found == {1: (1, 0), 2: (1, 0), 3: (3, 0), 4: (4, 0)}
    kept = near_dedup.keep_one(odd_docs(spark))
    assert kept.schema.names == odd_docs(spark).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "4", "None"]
    assert near_dedup.near_duplicates(empty_docs(spark)).count() == 0


def test_darts_agree_as_often_as_the_sets_are_similar():
    r = np.random.default_rng(2)
    elements = r.integers(0, 1 << 62, size=60).astype(np.uint64)
    left, right = r.uniform(0.2, 3, size=60), r.uniform(0.2, 3, size=60)
    right[30:] = left[30:]
    want = np.minimum(left, right).sum() / np.maximum(left, right).sum()
    a = near_dedup.dart_signatures(elements, left, np.array([0, 60]), 4096)[0]
    b = near_dedup.dart_signatures(elements, right, np.array([0, 60]), 4096)[0]
    assert (a != 0).all() and abs((a == b).mean() - want) < 0.04


def test_darts_are_the_earliest_of_each_coordinate():
    # written out dart by dart, for whole and for partial units
    rng = np.random.default_rng(11)
    for weights in (rng.integers(1, 4, 30).astype(float), rng.uniform(0.1, 3.0, 30)):
        elements, starts, n = rng.integers(0, 1 << 63, 30, dtype=np.uint64), np.array([0, 10, 10, 30]), 8
        found = near_dedup.dart_signatures(elements, weights, starts, n)
        assert not found[1].any()
        for k in (0, 2):
            total, best = weights[starts[k] : starts[k + 1]].sum(), {}
            limit = (n * np.log(n) + 2 * n) / total
            while len(best) < n:
                best = {}
                for i in range(starts[k], starts[k + 1]):
                    for level in range(int(np.ceil(weights[i]))):
                        with np.errstate(over="ignore"):
                            dart, rank = shingles.mixed(elements[i : i + 1] + np.uint64(level) * np.uint64(0x9E3779B97F4A7C15)), 0.0
                            while True:
                                dart = shingles.mixed(dart + np.uint64(0xD1B54A32D192ED03))
                                rank -= np.log((float(dart[0] >> np.uint64(11)) + 0.5) / (1 << 53))
                                if rank >= limit:
                                    break
                                place = shingles.mixed(dart ^ np.uint64(0xA0761D6478BD642F))
                                if float(place[0] >> np.uint64(11)) / (1 << 53) < min(1.0, weights[i] - level):
                                    name = int(shingles.mixed(dart + np.uint64(0x2545F4914F6CDD1D))[0])
                                    best[name % n] = min(best.get(name % n, (np.inf, 0)), (rank, name))
                limit *= 2
            assert found[k].tolist() == [best[c][1] for c in range(n)]


def test_signing_takes_less_time_than_as_many_additions():
    rng = random.Random(12)
    texts = pa.array([" ".join(f"{rng.randrange(1 << 40):x}," for _ in range(400)) for _ in range(512)])
    seconds = []
    for _ in range(3):
        start = time.process_time()
        near_dedup.dart_signatures(*shingles.weighted(*shingles.shingle_hashes(texts, 5)), 160)
        seconds.append(time.process_time() - start)
    unit = time.process_time()
    sum(range(20_000_000))  # what this machine takes for additions, as its speed varies
    unit = time.process_time() - unit
    assert min(seconds) < unit


def test_words_of_tokens_taken_together_are_those_of_each():
    tokens = ["ΟΔΟΣ", "Σ", "İstanbul,x", "a-b_c", "--", "Straße", "ΑΣ.", "\u2028x\ty", "\rΣ'", "日本", "x"]
    texts = pa.array(["  ".join(tokens), "\n".join(reversed(tokens)), "", "--", "ΟΔΟΣ\nΑΣ Σ"])
    words = [[w for token in re.split("[ \n]", t) for w in re.findall(r"\w+", token.lower())] for t in texts.to_pylist()]
    hashes, firsts = shingles.word_hashes(texts)
    assert np.diff(firsts).tolist() == [len(w) for w in words]
    assert (hashes == shingles.string_hashes(pa.array([w for ws in words for w in ws]))).all()


def test_one_bit_of_each_coordinate_tells_sets_apart():
    r = np.random.default_rng(4)
    elements = r.integers(0, 1 << 62, size=120).astype(np.uint64)
    a, b = (near_dedup.dart_signatures(x, np.ones(60), np.array([0, 60]), 160) for x in (elements[:60], elements[60:]))
    differ = sum(int(x).bit_count() for x in (near_dedup.one_bits(a) ^ near_dedup.one_bits(b)).view(np.uint64)[0])
    assert 50 < differ < 110


def test_similarity_is_exact():
    texts = ["a b c d e f g h", "a b c d e f g x", "a b a b a b a b a b", "a b a b a b a b", "one", "", "ONE."]
    pairs = [(i, j) for i in range(7) for j in range(7)]
    got = near_dedup.similarity(pa.array([texts[i] for i, _ in pairs]), pa.array([texts[j] for _, j in pairs]), 5)
    bags = [words_of(t) for t in texts]
    want = [(bags[i] & bags[j]).total() / max(1, (bags[i] | bags[j]).total()) for i, j in pairs]
    assert np.allclose(got, want)


def test_texts_with_too_many_shingles_of_their_own_are_settled_without_pairs(spark):
    passage = " ".join(f"p{k}" for k in range(40))
    rows = [(k, f"{passage} " + " ".join(f"own{k}x{n}" for n in range(20))) for k in range(30)] + [(90, passage + " end"), (91, passage + " other end"), (92, "")]
    docs = spark.createDataFrame(rows, "id long, text string")
    own = {r.id: r.own for r in near_dedup._own_shingles(docs, docs, 5).collect()}
    assert own == {k: 20 for k in range(30)} | {90: 1, 91: 2}
    named = docs.withColumnRenamed("id", "doc_id")
    # bands of one coordinate put all of them into common buckets
    assert {x.doc_id: x["class"] for x in near_dedup.near_duplicates(named, bands=24, rows=1).collect()} == brute_classes(rows)


def test_long_words_are_hashed_in_proportion_and_alike_everywhere():
    words = ["a" * 10_000_000, "a" * 9_999_999 + "b", "short", "a" * 257, "a" * 256]
    began = time.process_time()
    hashes = shingles.string_hashes(pa.array(words))
    assert time.process_time() - began < 2 and len(set(hashes.tolist())) == 5
    assert [shingles.string_hashes(pa.array([w]))[0] for w in words] == hashes.tolist()


def test_shingles_do_not_depend_on_their_neighbours():
    texts = ["a b c d e f", "", "x", "A, b\nc d e - f!"]
    hashes, starts = shingles.shingle_hashes(pa.array(texts), 5)
    assert np.diff(starts).tolist() == [2, 0, 1, 2]
    assert hashes[starts[0] : starts[1]].tolist() == hashes[starts[3] : starts[4]].tolist()


def odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(k, [float((k * 7 + j * 3) % 11 - 5) for j in range(4)]) for k in range(60)]
    rows += [(100, None), (120, [nan, 1.0, 1.0, 1.0]), (140, [inf, 1.0, 1.0, 1.0]), (160, [1.0, 2.0]), (180, []), (None, [1.0] * 4), (200, [0.0] * 4), (220, [1.0, None, 1.0, 1.0])]
    rows += [(k, [1.0, 2.0, 3.0, 4.0]) for k in range(300, 340)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def brute_top(rows, k, zero):
    held = [(i, np.array(v)) for i, v in rows if i is not None and v and len(v) == 4 and None not in v and np.isfinite(v).all() and (zero or any(v))]
    out = []
    for q, v in held:
        if q % 20 == 0:
            best = sorted((-float(v @ w), i) for i, w in held if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def test_exact_search_of_odd_rows(spark):
    rows = [(r.vec_id, r.embedding) for r in odd_vectors(spark).collect()]
    found = exact_top_k(odd_vectors(spark), F.col("id") % 20 == 0, 7)
    assert sorted((r.query_id, r["rank"], r["id"], float(r.score)) for r in found.collect()) == brute_top(rows, 7, True)
    assert exact_top_k(odd_vectors(spark).limit(0), F.col("id") % 20 == 0, 7).count() == 0


def test_exact_search_query(spark, sf_dir):
    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    want = sorted(connection.sql(SQL["op7_exact_top_k"]).fetchall())
    assert sorted(tuple(r) for r in op7_exact_top_k(spark, sf_dir).select("query_id", "rank", "vec_id", "score").collect()) == want


def test_neighbours_of_odd_rows(spark):
    rows = [(r.vec_id, r.embedding) for r in odd_vectors(spark).collect()]
    found = neighbours.nearest(odd_vectors(spark), F.col("id") % 20 == 0, 7)
    assert sorted((r.query_id, r["rank"], r["id"], r.score) for r in found.collect()) == brute_top(rows, 7, False)
    assert neighbours.nearest(odd_vectors(spark).limit(0), F.col("id") % 20 == 0, 7).count() == 0


def test_neighbours_recall(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 64)  # so that the graph is needed on few vectors
    monkeypatch.setattr(neighbours, "TREES", 3)
    got = neighbours.op5_nearest(spark, sf_dir).collect()
    rows = {r.vec_id: np.array(r.embedding, dtype=np.float64) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    hits = total = 0
    for q in [i for i in rows if i % 20 == 0]:
        best = {i for _, i in sorted((-float(rows[q] @ w), i) for i, w in rows.items() if i != q)[:20]}
        own = [r for r in got if r.query_id == q]
        assert [r["rank"] for r in sorted(own, key=lambda r: (-r.score, r.vec_id))] == list(range(1, len(own) + 1))
        assert all(abs(r.score - float(rows[q] @ rows[r.vec_id])) < 1e-12 for r in own)
        hits, total = hits + len(best & {r.vec_id for r in own}), total + len(best)
    assert hits >= 0.9 * total


def test_pipeline_keeps_its_promises(spark, sf_dir):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    good = pipeline.good_quality(spark, docs, sf_dir)
    kept = {r.doc_id: r for r in good.collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert kept.keys() <= before.keys()
    assert sum(labels[i] == 1 for i in kept if i in labels) >= 0.95 * sum(v == 1 for v in labels.values())
    single = {r.doc_id for r in pipeline.one_of_each(spark, good, sf_dir).collect()}
    classes = brute_classes([(i, r.text) for i, r in kept.items()])
    assert single == set(classes.values())
    clean = pipeline.without_secrets(spark, docs, sf_dir)
    assert clean.columns == pipeline.COLUMNS and clean.count() == len(before)
    assert all(r.n_chars == len(r.text) for r in clean.collect())
    mixed = pipeline.mixed(spark, clean, sf_dir)
    assert mixed.columns == pipeline.COLUMNS
    rows = mixed.collect()
    texts = spark.createDataFrame(rows, mixed.schema)
    check_packing([(r.doc_id, r.text) for r in rows], pipeline.packed(spark, texts, sf_dir).collect(), 1024)
    assert pipeline.run(spark, sf_dir).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
