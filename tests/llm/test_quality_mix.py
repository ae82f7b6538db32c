"""op1's gradient, repeated ratings and clashing columns; op10 with repeated rows against its SQL."""

import duckdb
import numpy as np
import pytest

from seqlake.llm import ordinal
from seqlake.llm.mixing import mix, mix_report
from seqlake.llm.queries import ORACLE


def _rated(spark, parts):
    docs = [(i, ("good clean prose here " if i % 2 else "bad junk spam lines ") * (i % 5 + 1), "x", [1.0]) for i in range(60)]
    docs += [(3, "another text of id three", "y", [2.0]), (3, "third text", "z", [3.0])]
    labels = [(i, i % 2, 0) for i in range(40)] + [(i, (i + 1) % 2, i % 3 == 0) for i in range(0, 20)]
    d = spark.createDataFrame(docs, "doc_id long, text string, expected_grade string, tails array<double>").repartition(parts)
    return d, spark.createDataFrame([(a, b, int(c)) for a, b, c in labels], "doc_id long, quality int, toxic int").repartition(parts)


def test_repeated_ratings_do_not_depend_on_partitions(spark):
    got = []
    for parts in (1, 3, 7):
        d, lab = _rated(spark, parts)
        got.append(sorted((r.doc_id, round(r.expected_grade, 9)) for r in ordinal.quality_report(d, lab).collect()))
    assert got[0] == got[1] == got[2] and len(got[0]) == 62


def test_kept_rows_keep_their_columns(spark):
    d, lab = _rated(spark, 2)
    kept = ordinal.keep(d, lab)
    assert kept.schema == d.schema
    want = {(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()}
    chosen = {(r.doc_id, r.text) for r in kept.select("doc_id", "text").collect()}
    assert chosen <= want and kept.where("tails is null or expected_grade is null").count() == 0
    flags = ordinal.quality_report(d, lab)
    assert flags.where("kept").count() == kept.count()


def test_edges(spark):
    d, lab = _rated(spark, 2)
    assert ordinal.keep(d.limit(0), lab).count() == 0 and ordinal.keep(d, lab.limit(0)).count() == d.count()
    odd = spark.createDataFrame([(None, None, "a", None), (1, "", "b", []), (1, "w " * 200_000, "c", None)], d.schema)
    assert ordinal.quality_report(odd, lab).count() == 3


def test_gradient_by_finite_differences():
    """One step of Adam from the start moves against the numeric gradient of the log likelihood."""
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 6, 3)) for _ in range(40)]
    y = rng.integers(0, 3, 40)
    share = [(y >= k + 1).mean() for k in range(2)]
    cut = -np.log(np.array(share) / (1 - np.array(share)))

    def likelihood(w):
        score = np.array([w[r].sum() for r in rows])
        up = np.concatenate((np.ones((40, 1)), 1 / (1 + np.exp(cut[None] - score[:, None]))), axis=1)
        low = np.concatenate((up[:, 1:], np.zeros((40, 1))), axis=1)
        return np.log(up[np.arange(40), y] - low[np.arange(40), y]).mean()

    num = np.array([(likelihood(np.eye(6)[j] * 1e-6) - likelihood(np.zeros(6))) / 1e-6 for j in range(6)])
    one = ordinal.OrdinalModel.fit(rows, y, steps=1, rate=0.05, l2=0.0)
    moved = one.weights[:6]
    assert (np.sign(moved[np.abs(num) > 1e-6]) == np.sign(num[np.abs(num) > 1e-6])).all()


REPEATED = [(i % 30, f"text {i % 30} " + "w " * (i % 7), ["a", "b", None][i % 3]) for i in range(200)] + [(None, "same", "b")] * 20 + [(5, None, "c")] * 3


@pytest.mark.parametrize("parts", [1, 6])
def test_repeated_rows_equal_sql(spark, parts):
    df = spark.createDataFrame(REPEATED, "doc_id long, text string, source string").repartition(parts)
    con = duckdb.connect()
    con.register("documents", df.toArrow())
    cur = con.execute(ORACLE["op10_weighted_fair_mix"])
    cols = [d[0] for d in cur.description]
    key = lambda rows: sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in t) for t in rows), key=repr)
    got = mix_report(df).select(*cols).collect()
    assert key(map(tuple, got)) == key(cur.fetchall())
    taken = sum(r["taken"] for r in mix_report(df).collect())
    out = mix(df.selectExpr("*", "map(1, doc_id) as m", "1 as _h"))
    assert out.columns == ["doc_id", "text", "source", "m", "_h"]
    assert sum(len((r.text or "").split()) for r in out.collect()) == taken
