"""Scale guard: in every SQL-checked query, a single-partition exchange may only
feed a one-row aggregate (no grouping keys), a window over a bounded table (``_pid``:
one row per partition; ``_b``: one per hash bucket) or a final top-k / limit; and no
exact percentile aggregate is left."""

import re

import pytest

import __spark_entry__ as entry
from tests.conftest import SF_SMALL

ALLOWED = (re.compile(r"^(Hash|ObjectHash|Sort)Aggregate\(keys?=\[\]"),
           re.compile(r"^Sort \[_pid(#\d+L?)? "),
           re.compile(r"^Sort \[_b(#\d+L?)? "),  # hash-bucket histogram: at most 65,536 rows
           re.compile(r"^(TakeOrderedAndProject|GlobalLimit|CollectLimit)"))


def _parent(lines, i):
    indent = len(lines[i]) - len(lines[i].lstrip(" :|+-"))
    for j in range(i - 1, -1, -1):
        ind = len(lines[j]) - len(lines[j].lstrip(" :|+-"))
        if ind < indent:
            return lines[j].strip(" :|+-")
    return ""


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_single_partition_exchanges_are_bounded(spark, name):
    df = entry.queries()[name](spark, SF_SMALL)
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            parent = _parent(lines, i)
            assert any(p.search(parent) for p in ALLOWED), f"{name}: unbounded single-partition input to {parent[:120]}"
    # an exact percentile keeps every distinct value of a column in one task
    assert not re.search(r"\bpercentile\(", "\n".join(lines)), f"{name}: exact percentile aggregate"


def test_kmer_stage_has_no_shuffle(spark):
    plan = entry.queries()["kmer_counts_strip"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "MapInPandas" in plan
