"""Word hashing in short runs: tables that stay in a worker are bounded, hashes do not depend on the runs."""

import numpy as np
import pyarrow as pa

from seqlake.llm import wordhash

ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _hashes(texts):
    out = []
    for _, _, data, off in wordhash.runs(pa.array(texts)):
        h, bounds, _, _ = wordhash.words(data, off)
        out += [h[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]
    return out


def test_tables_that_stay_in_a_worker_are_bounded():
    for n in (10, 70_000, 300_000, 1_100_000, 2_000_000, 5_000_000):
        power, inverse = wordhash._power_tables(n)
        assert len(power) > n and (power[:100] * inverse[:100] == 1).all() and power[n] * inverse[n] == np.uint64(1)
    kept = wordhash._powers.values() if isinstance(wordhash._powers, dict) else [wordhash._powers]
    assert sum(t.nbytes for pair in kept for t in pair) <= 16 << 20


def test_hashes_do_not_depend_on_the_runs():
    text = "the Quick brown fox " * 5_000  # 100 kB
    together = _hashes([text, None, text * 14, text, "the fox"])
    assert together == [*_hashes([text]), [], *_hashes([text * 14]), *_hashes([text]), *_hashes(["the fox"])]
    assert together[0] == together[3] == together[2][:len(together[0])] and together[4] == [together[0][0], together[0][3]]


def _widths(spark, monkeypatch, module):
    """Largest batch setting that a module's jobs ran with."""
    seen, write = [], module.materialize

    def noted(df, name, **kw):
        seen.append(int(spark.conf.get(ROWS)))
        return write(df, name, **kw)

    monkeypatch.setattr(module, "materialize", noted)
    return seen


def test_jobs_on_texts_run_in_short_batches(spark, docs_of, monkeypatch):
    from seqlake.llm import disclosure, jaccardjoin

    before = spark.conf.get(ROWS)
    spark.conf.set(ROWS, "10000")
    try:
        docs = docs_of([(i, f"one two three four five six seven {i // 2} mail a{i // 3}@b.org", "x") for i in range(12)])
        joins, found = _widths(spark, monkeypatch, jaccardjoin), _widths(spark, monkeypatch, disclosure)
        assert len({r["component_id"] for r in jaccardjoin.groups(docs).collect()}) == 8
        assert disclosure.report(docs).where("n_email = 1").count() == 12
        assert joins and found and max(joins[:-1]) <= 2048 and max(found) <= 2048  # groups stores the components last, no texts
        assert spark.conf.get(ROWS) == "10000"
    finally:
        spark.conf.set(ROWS, before)


def test_a_smaller_setting_stays(spark):
    from seqlake.session import short_batches

    before = spark.conf.get(ROWS)
    spark.conf.set(ROWS, "7")
    try:
        with short_batches(spark):
            assert spark.conf.get(ROWS) == "7"
        spark.conf.set(ROWS, "0")  # no bound
        with short_batches(spark):
            assert spark.conf.get(ROWS) == "2048"
        assert spark.conf.get(ROWS) == "0"
    finally:
        spark.conf.set(ROWS, before)


def test_the_classifier_takes_texts_in_slices():
    from seqlake.llm import ordinal

    batch = pa.RecordBatch.from_arrays([pa.array(range(2_500))], names=["x"])
    cut = list(ordinal._pieces([batch, batch.slice(0, 0), batch.slice(0, 3)]))
    assert [b.num_rows for b in cut] == [1_024, 1_024, 452, 3]
    assert pa.Table.from_batches(cut).column("x").to_pylist() == [*range(2_500), 0, 1, 2]
