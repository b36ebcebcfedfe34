import numpy as np
import pytest
from pyspark.sql import functions as F

from findling.functions import vectors as V
from findling.operators import vector as op


@pytest.fixture(scope="module")
def rows(spark):
    data = [("a", [1.0, 0.0], "public"), ("b", [1.0, 0.0], "layer_hr"), ("c", [0.0, 1.0], "default"), ("z", [0.0, 0.0], "public")]
    return spark.createDataFrame(data, "vec_id string, embedding array<double>, layer_id string")


def ids(df):
    return [r[0] for r in df.collect()]


def test_prefilter_never_leaks(rows):
    assert set(ids(op.prefilter(rows))) == {"a", "c", "z"}
    assert ids(op.top_k(rows, [1.0, 0.0], 1)) == ["a"]
    assert ids(op.top_k(rows, [1.0, 0.0], 2, allowed=["public", "default", "layer_hr"])) == ["a", "b"]


def test_threshold_comes_after_the_limit(rows, spark):
    assert ids(op.threshold_search(rows, [1.0, 0.0], 4)) == ["a"]
    pinned = spark.createDataFrame([("a",)], "vec_id string")
    assert ids(op.threshold_search(rows, [1.0, 0.0], 4, pinned=pinned)) == []


def test_similarity_modes(spark):
    got = spark.sql("SELECT explode(array(NULL, 0D, 0.3D, 1D, 1.5D, -0.2D)) d").select(F.round(V.similarity(F.col("d"), False), 3)).collect()
    assert [r[0] for r in got] == [0.0, 1.0, 0.7, 1.0, 1.0, 0.8]


def test_zero_vectors(rows):
    got = rows.filter("vec_id = 'z'").select(V.normalise(F.col("embedding")), V.cosine(F.col("embedding"), F.lit([1.0, 0.0]))).first()
    assert got[0] == [0.0, 0.0] and got[1] == 0.0


@pytest.mark.parametrize(("n", "want"), [(5, 10), (100, 10), (333, 34), (9000, 50)])
def test_rerank_width(spark, n, want):
    assert spark.range(1).select(V.rerank_width(n)).first()[0] == want


def test_fusion_is_symmetric(spark):
    a = spark.createDataFrame([("x", 3.0), ("y", 2.0)], "id string, s double")
    b = spark.createDataFrame([("y", 9.0), ("w", 1.0), (None, 5.0)], "id string, s double")
    one = {r["id"]: r["rrf"] for r in op.reciprocal_rank_fusion([(a, F.col("s").desc()), (b, F.col("s").desc())]).collect()}
    two = {r["id"]: r["rrf"] for r in op.reciprocal_rank_fusion([(b, F.col("s").desc()), (a, F.col("s").desc())]).collect()}
    assert one == pytest.approx(two) and set(one) == {"x", "y", "w"}
    assert one["y"] == pytest.approx(1 / 62 + 1 / 61)


@pytest.mark.parametrize("block", [op.BLOCK, 6])
def test_similarity_join_matches_brute_force(spark, monkeypatch, block):
    """Types that are strings or null, copies, zero vectors; small blocks bring pivots into play."""
    import numpy as np

    monkeypatch.setattr(op, "BLOCK", block)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 16))
    vectors = np.concatenate([base, base + 0.15 * rng.normal(size=base.shape), np.zeros((4, 16)), np.tile(base[:1], (8, 1))])
    data = [(i, ("t", None)[i % 2], v.tolist()) for i, v in enumerate(vectors)] + [(None, "t", base[0].tolist()), (200, "t", None)]
    got = sorted((r["source_id"], r["target_id"]) for r in op.similarity_join(spark.createDataFrame(data, "id long, type string, embedding array<double>"), 0.9).collect())
    first = {}
    for i, kind, v in data[: len(vectors)]:
        if any(v):
            first.setdefault((kind, tuple(v)), i)
    unit = {i: np.array(v) / np.linalg.norm(v) for (_, v), i in first.items()}
    want = [(i, j) for i in unit for j in unit if j < i and i % 2 == j % 2 and unit[i] @ unit[j] >= 0.9]
    want += [(i, first[kind, tuple(v)]) for i, kind, v in data[: len(vectors)] if any(v) and first[kind, tuple(v)] != i]
    assert got == sorted(want) and len(want) > 40


@pytest.mark.parametrize("shape", ["spread", "clustered"])
def test_similarity_join_sends_no_more_than_pairs_of_blocks(spark, monkeypatch, shape):
    """Where vectors visit most cells, they aren't written once for each; where they cluster, cells stay. No link is lost either way."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(op, "BLOCK", 12)
    monkeypatch.setattr(op, "PAIR", 40, raising=False)
    rng = np.random.default_rng(4)
    v = rng.normal(size=(300, 24)) if shape == "spread" else np.repeat(rng.normal(size=(20, 24)), 15, axis=0) + 0.05 * rng.normal(size=(300, 24))
    v = v.astype(np.float32)
    tables, write = [], op.written
    monkeypatch.setattr(op, "written", lambda df, name: tables.append(write(df, name)) or tables[-1])
    least = 0.4 if shape == "spread" else 0.9
    rows = spark.createDataFrame([(i, "t", x.tolist()) for i, x in enumerate(v)], "id long, type string, embedding array<float>")
    links = op.similarity_join(rows, least)
    got = links.select("source_id", "target_id", F.round("similarity", 6).alias("s")).collect()
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1)[:, None]
    near = u @ u.T
    assert sorted((r[0], r[1]) for r in got) == [(i, j) for i in range(300) for j in range(i) if near[i, j] >= least] and len(got) > 60
    assert all(abs(r["s"] - near[r[0], r[1]]) < 1e-6 for r in got)
    assert sum(t.count() for t in tables) < 2 * 300
    cells = {r["c"] for r in tables[-1].collect()}
    assert len(cells) > 5 if shape == "clustered" else cells == {0}


def test_similarity_join_without_links(spark):
    data = [(1, "a", [1.0, 0.0]), (2, "a", [0.0, 1.0]), (3, "b", [1.0, 0.0])]
    rows = spark.createDataFrame(data, "id long, type string, embedding array<double>")
    assert op.similarity_join(rows).count() == 0 and op.similarity_join(rows.limit(0)).count() == 0


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_index_reads_few_cells_without_loss(spark, metric):
    """Clustered vectors: the results of the full scan, from a part of the cells; layers are looked at before ranking."""
    import tempfile

    from findling.operators.vector_index import VectorIndex

    rng = np.random.default_rng(8)
    centers = rng.normal(size=(12, 6)) * 4
    v = centers[rng.integers(12, size=900)] + 0.2 * rng.normal(size=(900, 6))
    rows = [(i, r.tolist(), ("public", "layer_a")[i % 2]) for i, r in enumerate(v)] + [(1000, None, "public")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, layer_id string")
    index = VectorIndex(spark, tempfile.mkdtemp(prefix="findling-"), metric)
    index.build(df, 24)
    for q in (v[0] * 1.01, centers[3], rng.normal(size=6)):
        for allowed in (None, ["layer_a"]):
            want = op.top_k(df, q.tolist(), 7, metric, allowed).collect()
            got = index.search(q.tolist(), 7, allowed, first=2).collect()
            assert [r["vec_id"] for r in got] == [r["vec_id"] for r in want]
            assert len(index.cells_read) < 24
    plan = index.read([1, 2])._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "cell" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_similarity_matrix_in_bounded_blocks(spark, monkeypatch):
    """Blocks of rows grow in number with the rows, not in size; all pairs are there."""
    monkeypatch.setattr(op, "BLOCK", 20)
    rows = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(2000)], "vec_id long, embedding array<float>")
    found = op.similarity_matrix(rows, rows.filter("vec_id % 50 = 0"), "vec_id")
    assert "sequence(0, 99" in found._jdf.queryExecution().analyzed().toString()
    got = found.collect()
    assert len(got) == 2000 * 40 and all(r["dot"] == (r["a"] % 7) * (r["b"] % 7) + 1 for r in got)
