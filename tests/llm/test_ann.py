import numpy as np
from pyspark.sql import functions as F

from tessera.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int, vec string, rank int"


def test_recall_and_exact_scores(spark):
    r = np.random.default_rng(3)
    centres = r.normal(size=(12, 32))
    x = (centres[r.integers(0, 12, 2500)] + 0.7 * r.normal(size=(2500, 32))).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[100:400] = x[100]  # a common vector
    rows = [(int(i * 3), v.tolist(), 0, "", 0) for i, v in enumerate(x)]
    odd = [(9001, None, 0, "", 0), (9004, [0.0] * 32, 0, "", 0), (9007, [float("nan")] * 32, 0, "", 0), (9010, [1.0] * 3, 0, "", 0), (9013, [None] + [1.0] * 31, 0, "", 0), (None, x[0].tolist(), 0, "", 0), (9016, [float("inf")] + [1.0] * 31, 0, "", 0)]
    df = spark.createDataFrame(rows + odd, SCHEMA).repartition(4)
    old = ann.ROW_BLOCK, ann.QUERY_BLOCK
    ann.ROW_BLOCK, ann.QUERY_BLOCK = 700, 50
    try:
        got = {}
        for row in ann.nearest(df, df.where(F.col("vec_id") % 20 == 0), k=20).collect():
            got.setdefault(row.query_id, []).append(row)
    finally:
        ann.ROW_BLOCK, ann.QUERY_BLOCK = old
    ids = np.arange(2500) * 3
    v = x.astype(np.float64)
    want = ann.brute_force(ids, v, np.flatnonzero(ids % 20 == 0), 20)
    assert set(got) == set(want)
    hit = 0
    for k, rs in got.items():
        rs.sort(key=lambda z: z.rank)
        assert [z.rank for z in rs] == list(range(1, 21)) and all(z.vec_id != k for z in rs)
        assert [(-z.score, z.vec_id) for z in rs] == sorted((-z.score, z.vec_id) for z in rs)
        assert all(abs(z.score - v[z.vec_id // 3] @ v[k // 3]) < 1e-12 for z in rs)
        hit += len({z.vec_id for z in rs} & set(want[k]))
    assert hit / (20 * len(want)) > 0.95
    assert [z.vec_id for z in got[300]] == [303 + 3 * i for i in range(20)]


def test_few_rows(spark):
    df = spark.createDataFrame([(20, [1.0, 0.0], 0, "", 0), (21, [0.5, 0.5], 0, "", 0), (21, [0.5, 0.5], 0, "", 0)], SCHEMA)
    out = ann.nearest(df, df.where("vec_id = 20")).collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in out] == [(20, 1, 21, 0.5)]
    assert ann.nearest(df.limit(0), df).count() == 0 and ann.nearest(df, df.limit(0)).count() == 0
