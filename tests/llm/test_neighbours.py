import numpy as np
import pytest

from brightloom.llm import neighbours as N
from brightloom.llm import queries


def vectors(n, seed=0, size=64):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, size))
    x = centres[rng.integers(0, 12, n)] + rng.normal(size=(n, size))
    x[1::4] = x[0::4][: len(x[1::4])] + rng.normal(size=(len(x[1::4]), size)) * 0.15  # near pairs
    return x.astype(np.float32)


def frame(spark, x, names=None):
    rows = [(f"v{i:05d}" if names is None else names[i], v if v is None else [float(e) for e in v]) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "chunk_id string, embedding array<float>").selectExpr("*", "1 as id", "2 as cell", "3 as h")


@pytest.mark.parametrize("kw", [{}, {"per_cell": 20, "probes": 10}, {"per_cell": 2, "sample": 400, "probes": 10}, {"block": 50}])
def test_recall(spark, kw):
    x = vectors(800)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = {(f"v{i:05d}", f"v{j:05d}") for i in range(len(x)) for j in np.argsort(-s[i])[:10] if s[i, j] >= 0.9}
    got = {(r["id"], r["neighbour"]) for r in N.most_similar(frame(spark, x), "chunk_id", "embedding", least=0.9, **kw).collect()}
    assert len(want) > 300 and len(want & got) / len(want) >= 0.9 and got <= want


def test_all_neighbours_without_a_floor(spark):
    x = vectors(300, 3)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    got = {(r["id"], r["neighbour"]) for r in N.most_similar(frame(spark, x), "chunk_id", "embedding", k=5).collect()}
    want = {(f"v{i:05d}", f"v{j:05d}") for i in range(len(x)) for j in np.argsort(-s[i])[:5]}
    assert len(want & got) / len(want) >= 0.95


def test_copies_bad_vectors_and_queries(spark):
    x = list(vectors(60, 5))
    hot = [x[0]] * 40  # a large part of the rows are one vector
    bad = [None, [0.0] * 64, [1.0] * 63, [float("nan")] * 64, [float("inf")] + [1.0] * 63, []]
    names = [f"a{i:03d}" for i in range(60)] + [f"h{i:03d}" for i in range(40)] + [f"b{i}" for i in range(6)]
    df = frame(spark, x + hot + bad, names)
    df = df.unionByName(df.where("chunk_id = 'a005'"))
    queries = spark.createDataFrame([("q1", [float(e) * 3 for e in x[7]]), ("q2", None), ("q3", [0.0] * 64)], "id string, vector array<float>")
    rows = N.most_similar(df, "chunk_id", "embedding", queries, k=10, least=0.9).collect()
    of = {}
    for r in rows:
        of.setdefault((r["is_query"], r["id"]), []).append(r["neighbour"])
    assert of[(False, "h020")] == ["a000", *[f"h{i:03d}" for i in range(9)]]
    assert of[(True, "q1")][0] == "a007" and not any(k[0] and k[1] != "q1" for k in of)
    assert all(len(v) == len(set(v)) <= 10 and k[1] not in v for k, v in of.items())
    assert not any(n.startswith("b") for v in of.values() for n in v)
    assert N.most_similar(df.limit(0), "chunk_id", "embedding").count() == 0


def test_every_vector_has_its_neighbours_without_a_floor(spark, tmp_path):
    x = np.random.default_rng(9).normal(size=(400, 64)).astype(np.float32)  # no pair is near 0.90
    frame(spark, x).select("chunk_id", "embedding").write.parquet(str(tmp_path / "vector_records.parquet"))
    spark.createDataFrame([("q1", [float(e) for e in x[3]])], "request_id string, query_vector array<float>").write.parquet(str(tmp_path / "retrieval_inputs.parquet"))
    rows = queries.p2_neighbours(spark, str(tmp_path)).collect()
    assert len(rows) == 401 * 10
    assert {(r["key_a"], r["key_b"]) for r in queries.p2_found(spark, str(tmp_path)).collect()} == {("v00003", "q1")}


def test_more_cells_than_the_beam():
    x = vectors(2000, 7)
    books = N.Codebooks.fit(x, [40, 16], 1, 4)
    top, _, cells = books.encode(x, 4, looks=25)
    assert books.cell_number(cells).shape == (2000, 25) and (top == books.encode(x, 4)[0]).all()
    assert all(len(set(row)) == 25 for row in books.cell_number(cells)[:50].tolist())


@pytest.mark.parametrize("kw", [{"per_cell": 64}, {"per_cell": 64, "sample": 800}])
def test_recall_without_a_floor_in_many_cells(spark, kw):
    x = vectors(6000, 5)
    levels = N.plan_sizes(len(x), kw["per_cell"], 4, kw.get("sample", 6000))[1]
    assert levels == (2 if "sample" in kw else 1)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u[::20] @ u.T
    s[np.arange(len(s)), np.arange(0, len(x), 20)] = -2
    got = {(r["id"], r["neighbour"]) for r in N.most_similar(frame(spark, x), "chunk_id", "embedding", **kw).collect()}
    want = {(f"v{i * 20:05d}", f"v{j:05d}") for i in range(len(s)) for j in np.argsort(-s[i])[:10]}
    assert len(want & got) / len(want) >= 0.9


def test_disk_does_not_follow_the_cells_looked_into(spark, tmp_path):
    def moved(n, **kw):
        """Bytes written by shuffles for each vector searched."""
        store, tracker = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext.statusTracker()
        spark.sparkContext.setJobGroup(f"moved {n} {kw}", "")
        x = frame(spark, vectors(n, 11))
        N.most_similar(x, "chunk_id", "embedding", least=0.9, per_cell=32, **kw).write.parquet(str(tmp_path / f"{n} {len(kw)}"))
        stages = {s for j in tracker.getJobIdsForGroup(f"moved {n} {kw}") for s in tracker.getJobInfo(j).stageIds}
        spark.sparkContext.setJobGroup("other", "")
        return sum(store.lastStageAttempt(s).shuffleWriteBytes() for s in stages if tracker.getStageInfo(s)) / n

    few, many = moved(4000), moved(4000, probes=60)
    assert many < 1.1 * few and few < 5 * 64 * 4


def test_similar_cells_follow_each_other():
    rng = np.random.default_rng(1)
    c = rng.normal(size=(40, 8))
    order = N._line(c)
    assert sorted(order) == list(range(40))
    steps = np.linalg.norm(np.diff(c[order], axis=0), axis=1).mean()
    assert steps < np.mean([np.linalg.norm(np.diff(c[rng.permutation(40)], axis=0), axis=1).mean() for _ in range(20)])
