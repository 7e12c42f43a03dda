"""Top-k: sums that doubles do not hold, and queries in many blocks."""

import random

import pytest

from ledgerline.llm import topk


def plain(rows, queries, k):
    out = []
    for qid, q in queries:
        scores = sorted(((-sum(int(a) * int(b) for a, b in zip(q, v)), i) for i, v in rows if i != qid))[:k]
        out += [(qid, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    return sorted(out)


@pytest.mark.parametrize("size", [100, 1 << 28])
@pytest.mark.parametrize("query_bytes", [1 << 20, 300])
def test_scores_are_exact_in_any_number_of_blocks(spark, size, query_bytes):
    r = random.Random(size)
    # Large parts that cancel, so that only the last digits tell the rows apart.
    rows = [(i, [float(size), float(-size + r.randrange(3)), float(r.randrange(4)), 1.0]) for i in range(150)]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>").repartition(3)
    queries = df.where("vec_id % 10 = 0")
    got = sorted(tuple(x) for x in topk.top_k(df, queries, 4, query_bytes).collect())
    assert got == plain(rows, [x for x in rows if x[0] % 10 == 0], 4)


def test_a_score_beyond_longs_raises(spark):
    df = spark.createDataFrame([(0, [2.0**40]), (1, [2.0**40])], "vec_id long, v array<double>")
    with pytest.raises(Exception, match="no long"):
        topk.top_k(df, df).collect()
