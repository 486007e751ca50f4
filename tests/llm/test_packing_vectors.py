"""Packing, vector codes and clusters against plain loops, with nulls, ties, repeats, odd rows and empty tables."""

import hashlib
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import bin_packing, clustering, oracle, queries, vector_codes, vectors

PATH = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
VECTORS = "vec_id long, embedding array<float>, label int"


def tokenizer():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def best_fit(lengths, room):
    """What remains in each sequence after best-fit decreasing, piece by piece."""
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [(left, i) for i, left in enumerate(bins) if left >= n]
        if fits:
            bins[min(fits)[1]] -= n
        else:
            bins.append(room - n)
    return sorted(bins)


def brute_pieces(texts, end, room):
    t, out = tokenizer(), []
    for i, text in texts:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, end]
        first = len(ids) % room if len(ids) > room else len(ids)
        at = [0] if len(ids) <= room else [*([0] if first else []), *range(first, len(ids), room)]
        out += [(i, k, lo, ids[lo:hi]) for k, (lo, hi) in enumerate(zip(at, [*at[1:], len(ids)], strict=True))]
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    words = ["alpha", "beta,", "gamma's", "x1y2", "  two", "naïve", "中文字", "a\nb", "\t", "½²3", "<|endoftext|>"]
    out = [" ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 20, 70]))) for _ in range(60)]
    out += [None, "", " ", "\n\n", "one", "one", "a\x1cb!\x1c c", "word " * 5000, "unbroken" * 3000, out[0]]
    return list(enumerate(out))


@pytest.mark.parametrize("room", [16, 100, 1024])
def test_packing_equals_the_loop(spark, texts, room):
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts], DOCS).withColumn("ids", F.lit("x")).withColumn("_part", F.lit(7)).repartition(4)
    got = bin_packing.pack_documents(docs, PATH, 2, room).collect()
    expected = brute_pieces(texts, 2, room)
    assert sorted((r["doc_id"], r["piece"], r["start"], np.frombuffer(r["ids"], "<u4").tolist()) for r in got) == sorted(expected)
    assert all(r["length"] == len(r["ids"]) // 4 for r in got)
    held = {}
    for r in got:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in held.values():
        places.sort()
        assert [o for o, _ in places] == np.r_[0, np.cumsum([n for _, n in places])][:-1].tolist()
    assert sorted(room - sum(n for _, n in p) for p in held.values()) == best_fit([len(e[3]) for e in expected], room)


def test_plans_pack_as_the_loop_does():
    rng = random.Random(9)
    for _ in range(60):
        room = rng.choice([5, 8, 64, 100])
        counts = Counter(rng.randint(1, room) for _ in range(rng.randrange(200)))
        plan = bin_packing.packing_plan(counts, room)
        left = Counter()
        for length, first, sequence, each, offset in plan.tolist():
            n = min([f for v, f, *_ in plan.tolist() if v == length and f > first], default=counts[length]) - first
            assert offset + min(n, each) * length <= room
            for k in range(n):
                left[sequence + k // each] += length
        assert sorted(room - v for v in left.values()) == best_fit(counts.elements(), room)
    plan = bin_packing.packing_plan({i: 10**9 + i for i in range(1, 1025)}, 1024)  # as small for any number of pieces
    assert len(plan) < 30 * 1024


def test_segment_tree():
    tree, kept, rng = bin_packing.Capacities(100), Counter(), random.Random(2)
    for _ in range(2000):
        c = rng.randint(0, 100)
        by = 1 if rng.random() < 0.4 or not kept[c] else -1
        tree.add(c, by)
        kept[c] += by
        need = rng.randint(0, 100)
        assert tree.tightest(need) == min((x for x in kept if x >= need and kept[x]), default=None)


def test_words_and_stretches_keep_the_ids():
    rng, t = random.Random(1), tokenizer()
    marks = "ab Zz  \n\t\r\x0b\x0c\x1c\x1f\x85\xa0    　᠎​.,'sé中1½!-_"
    odd = ["".join(rng.choice(marks) for _ in range(rng.randrange(50))) for _ in range(4000)] + [" ".join(rng.choice(["ab", "cd.", "ef\n", "  x"]) for _ in range(3000))]
    got = dict(bin_packing._encoded(odd, bin_packing.Encoder(PATH), 2, 300))
    assert all(got[i].tolist() == [*e.ids, 2] for i, e in enumerate(t.encode_batch(odd, add_special_tokens=False)))
    assert "".join(bin_packing.stretches(odd[-1], 100)) == odd[-1] and len(list(bin_packing.stretches(odd[-1], 100))) > 10


def test_op11_and_sequences(spark, texts, tmp_path):
    spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts] + [(None, "no id", None, None, None)], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["doc_id"], r["piece"]): r for r in queries.op11_best_fit(spark, str(tmp_path)).collect()}
    expected = brute_pieces([*texts, (None, "no id")], 2, 1024)
    assert len(got) == len(expected)
    for i, k, start, ids in expected:
        r = got[i, k]
        assert (r["start"], r["length"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    packed = bin_packing.pack_documents(spark.read.parquet(f"{tmp_path}/documents.parquet"), PATH).cache()
    whole = {r["sequence_id"]: np.frombuffer(r["ids"], "<u4") for r in bin_packing.sequences(packed).collect()}
    for r in packed.collect():
        assert whole[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]].tobytes() == bytes(r["ids"])
    assert all(len(x) <= 1024 for x in whole.values())
    none = bin_packing.pack_documents(spark.createDataFrame([], DOCS), PATH)
    assert none.count() == 0 and none.columns == packed.columns


# vectors


def near(points, entries):
    far = ((points[:, None, :] - entries[None]) ** 2).sum(2)
    return far.argmin(1), far.min(1)


def lloyd(points, entries, rounds):
    entries = entries.copy()
    for _ in range(rounds):
        at, _ = near(points, entries)
        for e in set(at.tolist()):
            mine = points[at == e]
            entries[e] = mine.sum(0) // len(mine)
    return entries, *near(points, entries)


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """Vectors in clumps, with repeats, ties, a hot label, and rows that are left out."""
    rng = np.random.default_rng(4)
    middles = rng.normal(size=(30, 64)).astype(np.float32)
    rows = [(i, (middles[rng.integers(30)] + 0.2 * rng.normal(size=64)).astype(np.float32).tolist(), None if i % 7 == 0 else 1 if i % 3 == 0 else i % 40) for i in range(700)]
    rows += [(1000 + i, rows[3][1], 5) for i in range(300)] + [rows[3], (2000, [0.0] * 64, None), (2001, [-0.0] * 64, None)]
    bad = [(3000, None, 1), (3001, [float("nan")] + [0.0] * 63, 1), (3002, [None] + [0.0] * 63, 1), (3003, [float("inf")] * 64, 1), (3004, [1.0] * 63, 1), (3005, [], 1)]
    folder = str(tmp_path_factory.mktemp("vectors"))
    spark.createDataFrame(rows + bad, VECTORS).withColumn("code", F.lit("x")).withColumn("cluster", F.lit(9)).repartition(5).write.parquet(f"{folder}/embeddings.parquet")
    return folder, sorted(rows, key=lambda r: r[0])


def test_op12(spark, table):
    folder, rows = table
    points = np.floor(1024 * np.array([r[1] for r in rows], np.float64)).astype(np.int64)
    found = [lloyd(points[:, p : p + 16], points[:256, p : p + 16], 4) for p in range(0, 64, 16)]
    error = sum(f[2] for f in found)
    by_label = Counter()
    for r, e in zip(rows, error.tolist(), strict=True):
        by_label[r[2]] += e
    told = hashlib.sha256(",".join(str(x) for f in found for x in f[0].ravel()).encode()).hexdigest()
    expected = sorted((r[0], "".join(f"{f[1][i]:02x}" for f in found), int(error[i]), by_label[r[2]], told) for i, r in enumerate(rows))
    got = queries.op12_vector_codes(spark, folder)
    assert sorted(tuple(r) for r in got.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()) == expected


def test_op13(spark, table):
    folder, rows = table
    points = np.floor(256 * np.array([r[1] for r in rows], np.float64)).astype(np.int64)
    order = sorted(range(len(rows)), key=lambda i: hashlib.sha256(f"2:{rows[i][0]}".encode()).hexdigest())[:40]
    centroids, at, far = lloyd(points, points[order], 5)
    told = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    expected = sorted((r[0], int(at[i]), int(far[i]), int(far[at == at[i]].sum()), int(far.sum()), told[at[i]]) for i, r in enumerate(rows))
    got = queries.op13_clusters(spark, folder)
    assert sorted(tuple(r) for r in got.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()) == expected
    found = clustering.cluster_vectors(spark.read.parquet(f"{folder}/embeddings.parquet"))
    assert found.scanned[0] == len(rows) and found.scanned[-1] < len(rows) // 2  # bounds spare most of what lies in clumps


def test_filtering_equals_comparing_with_all():
    rng = np.random.default_rng(7)
    for n, k, d, most in ((1, 1, 1, 5), (5, 9, 2, 2), (400, 60, 2, 50), (1000, 256, 16, 900), (700, 40, 3, 4), (900, 30, 4, 1 << 24)):
        points, entries = rng.integers(-most, most + 1, (n, d)), rng.integers(-most, most + 1, (k, d))
        points[n // 2 :] = points[: n - n // 2]  # repeats
        tree = vector_codes.Tree.of(vector_codes.Tree.build(points).cells(), d)
        sums = np.zeros((k, d + 1), np.int64)
        got, whole_nodes = vector_codes.filtered(tree, entries, sums, step=1 << 12)
        assert (tree.points == points[tree.rows]).all() and (got == near(tree.points, entries)[0]).all()
        assert (sums[:, -1] == np.bincount(got, minlength=k)).all() and (sums[:, :-1].sum(0) == points.sum(0)).all()
    clumps = rng.integers(-5, 6, (2000, 2)) + 10_000 * rng.integers(0, 4, (2000, 1))
    got, whole_nodes = vector_codes.filtered(vector_codes.Tree.build(clumps), np.array([[0, 0], [10_000, 10_000], [20_000, 20_000], [30_000, 30_000]]))
    assert whole_nodes > 1900  # nearly all go with their node


def test_bounds_settle_as_full_scans_do():
    rng = np.random.default_rng(8)
    points, centroids = rng.integers(-9, 10, (500, 3)), rng.integers(-9, 10, (12, 3))
    centroids[5] = centroids[2]  # equal centroids always tie
    state, moves = (np.zeros(500, np.int64), np.full(500, np.inf), np.zeros(500)), clustering.Moves.between(centroids, centroids)
    for _ in range(8):
        *state, _ = clustering.settle(points, *state, moves)
        assert (state[0] == near(points, moves.centroids)[0]).all()
        moves = clustering.Moves.between(moves.centroids, moves.centroids + rng.integers(-1, 2, centroids.shape) * (rng.random((12, 1)) < 0.4))


def test_odd_vectors(spark):
    none = spark.createDataFrame([], VECTORS)
    assert vector_codes.compress_vectors(none).rows.count() == 0 and clustering.cluster_vectors(none).rows.count() == 0
    some = spark.createDataFrame([(None, [1.0, 2.0, 3.0], None), (1, [1e38, -1e38, 0.0], 2), (1, [0.5, 0.5, 0.5], 2), (2, [1.0], 3)], VECTORS)
    coded = vector_codes.compress_vectors(some, parts=2)
    assert sorted((r["error"] for r in coded.rows.collect())) == [0, 0, 0] and len(coded.codebooks[0]) == 3 and coded.codebooks[0].max() == vectors.MOST
    back = {r["vec_id"]: r["embedding"] for r in vector_codes.decoded(coded).collect()}
    assert np.allclose(back[None][:3], [1, 2, 3], atol=1 / 1024)
    found = clustering.cluster_vectors(some, clusters=2, rounds=0, width=3)
    assert sorted(r["cluster"] for r in found.rows.collect()) in ([0, 0, 1], [0, 1, 1])
    with pytest.raises(ValueError):
        vector_codes.compress_vectors(some, entries=300)


def test_sums_of_many_keys(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BROADCAST_ROWS", 10)
    monkeypatch.setattr(vectors, "HEAVY_PART", 10)
    rows = spark.createDataFrame([(i, None if i % 4 == 0 else 7 if i % 4 == 1 else i, i) for i in range(400)], "id int, label int, error long")
    got = {r["id"]: r["t"] for r in vectors.join_total(rows, "label", "error", "t").collect()}
    assert len(got) == 400 and got[0] == got[4] == sum(range(0, 400, 4)) and got[1] == got[7] == 7 + sum(range(1, 400, 4)) and got[2] == 2


@pytest.mark.parametrize("name", ["op12_vector_codes", "op13_clusters"])
def test_equals_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{folder}/embeddings.parquet'")
    said = con.execute(oracle.oracle_sql()[name])
    names = [c[0] for c in said.description]
    got = queries.queries()[name](spark, folder)
    assert set(got.columns) == set(names) and sorted(map(tuple, got.select(*names).collect())) == sorted(said.fetchall())
