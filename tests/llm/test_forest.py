import numpy as np
from pyspark.sql import functions as F

from hemiciclo.llm.forest import leaves, nearest


def brute(vectors, k, least):
    keys = sorted(x for x in vectors)
    unit = np.array([vectors[x] / np.linalg.norm(vectors[x]) for x in keys])
    s = np.round(unit @ unit.T, 9)
    out = set()
    for i, a in enumerate(keys):
        best = sorted(((-s[i, j], b) for j, b in enumerate(keys) if j != i))[:k]
        out |= {(a, b) for c, b in best if -c >= least}
    return out


def found(spark, rows, k, least, **kw):
    df = spark.createDataFrame(rows, "id string, v array<double>").withColumn("dir", F.lit(1)).withColumn("key", F.lit("a")).withColumn("tree", F.lit(0))
    return {(r["id"], r["neighbour"]) for r in nearest(df, "id", "v", k, least, **kw).collect()}


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((150, 24))
    vectors = {f"v{i:04}": (centres[i % 150] + 0.25 * rng.standard_normal(24)) * rng.uniform(0.1, 9) for i in range(1500)}
    rows = [(k, v.tolist()) for k, v in vectors.items()]
    want = brute(vectors, 5, 0.9)
    got = found(spark, rows, 5, 0.9, leaf=128, bucket_rows=256)
    assert len(want) > 500 and len(got & want) / len(want) > 0.95 and len(got - want) / len(got) < 0.05


def test_one_direction_many_times_and_broken_vectors(spark):
    rows = [(f"s{k:02}", [1.0 * (k + 1), 2.0 * (k + 1)]) for k in range(12)] + [("z", [0.0, 0.0]), ("n", None), ("e", []), ("nan", [float("nan"), 1.0]), ("hole", [None, 1.0]), ("other", [1.0, -2.0]), ("wide", [1.0, 2.0, 0.0])]
    got = found(spark, rows, 5, 0.9)
    assert {b for a, b in got if a == "s11"} == {f"s{k:02}" for k in range(5)}
    assert {b for a, b in got if a == "s02"} == {"s00", "s01", "s03", "s04", "s05"}
    assert {a for a, _ in got} == {f"s{k:02}" for k in range(12)}


def test_dense_cluster_keeps_all_rows(spark):
    rng = np.random.default_rng(6)
    base = rng.standard_normal(16)
    rows = [(f"d{i:04}", (base + 1e-4 * rng.standard_normal(16)).tolist()) for i in range(900)]
    got = found(spark, rows, 5, 0.9, leaf=64, bucket_rows=100)
    assert len({a for a, _ in got}) == 900 and len(got) == 4500


def test_few(spark):
    assert found(spark, [], 5, 0.0) == set()
    assert found(spark, [("a", [1.0])], 5, -1.0) == set()


def test_few_beside_a_dense_bundle(spark):
    rng = np.random.default_rng(8)
    base = rng.standard_normal(24)
    vectors = {f"d{i:04}": base + 0.15 * rng.standard_normal(24) for i in range(6000)}
    aside = base + 0.3 * rng.standard_normal(24)
    vectors |= {f"few{i:02}": aside + 0.02 * rng.standard_normal(24) for i in range(3)}
    got = found(spark, [(k, v.tolist()) for k, v in vectors.items()], 5, 0.9, leaf=96)
    want = {(a, b) for a, b in brute(vectors, 5, 0.9) if a[0] == "f"}
    assert len(want) == 15 and len(got & want) >= 14


def test_small_part_and_all_of_its_sibling_meet():
    codes = np.sort(np.concatenate([np.arange(3), (1 << 59) + np.arange(500) * (1 << 40)]))
    met = np.zeros((503, 503), int)
    for rows, others in leaves(codes, np.eye(503, dtype=np.float32), 64, 48):
        met[np.ix_(rows, rows if others is None else others)] += 1
        if others is not None:
            met[np.ix_(others, rows)] += 1
    assert (met[:3] > 0).all() and (met[:, :3] > 0).all()
