"""Properties over generated tiers, boundaries and arrays."""

from __future__ import annotations

import datetime as dt
from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pyspark.sql import types as T

from tierview import Boundary, TableSpec, read_range, reconcile, unify
from tierview.functions import codec
from tierview.operators import audit
from tierview.operators.boundary import global_boundary

few = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
times = st.lists(st.one_of(st.none(), st.integers(-50, 50)), max_size=30)
edge = st.integers(-60, 60)


def frame(spark, values):
    return spark.createDataFrame([(v,) for v in values], "recordTimestamp long")


@few
@given(hot=times, cold=times, cut=st.one_of(st.none(), edge), low=edge, high=edge)
def test_each_row_is_served_by_the_tier_the_boundary_gives_it_to(spark, hot, cold, cut, low, high):
    h, c, spec = frame(spark, hot), frame(spark, cold), TableSpec()
    plan = reconcile(h.schema, c.schema, spec)
    at = global_boundary(h, spec) if cut is None else Boundary("bigint", cut)
    timed = [t for t in hot if t is not None]
    if cut is None:
        assert at.value == (min(timed) if timed else 9999999999999)
    expected = Counter(t for t in cold if t is not None and t < at.value) + Counter(t for t in timed if t >= at.value)
    assert Counter(r[0] for r in unify(h, c, plan, at).collect()) == expected
    ranged = read_range(h, c, plan, at, Boundary("bigint", low), Boundary("bigint", high))
    assert Counter(r[0] for r in ranged.collect()) == Counter(t for t in expected.elements() if low <= t < high)
    shown = {r.tier: (r.n_rows, r.shown, r.hidden, r.null_times) for r in audit.tier_audit(h, c, plan, at).collect()}
    assert shown["cold"][1] + shown["hot"][1] == sum(expected.values())
    assert all(n == s + hidden + nulls for n, s, hidden, nulls in shown.values())


@few
@given(
    kind=st.sampled_from(["bigint", "date", "datetime"]),
    rows=st.lists(st.tuples(st.integers(-40, 40), st.booleans()), max_size=25),
    cut=edge,
    low=st.one_of(st.none(), edge),
    high=st.one_of(st.none(), edge),
)
def test_ranges_of_every_kind_and_with_open_ends(spark, kind, rows, cut, low, high):
    start = dt.datetime(2024, 1, 1)
    at = {
        "bigint": lambda n: n,
        "date": lambda n: start.date() + dt.timedelta(days=n),
        "datetime": lambda n: start + dt.timedelta(seconds=n),
    }[kind]
    column = {"bigint": "long", "date": "date", "datetime": "timestamp_ntz"}[kind]
    hot, cold = (
        spark.createDataFrame([(at(n),) for n, is_hot in rows if is_hot == side], f"recordTimestamp {column}") for side in (True, False)
    )
    spec = TableSpec(time_type=kind)
    limits = [None if n is None else Boundary(kind, at(n)) for n in (low, high)]
    got = read_range(hot, cold, reconcile(hot.schema, cold.schema, spec), Boundary(kind, at(cut)), *limits)
    served = [n for n, is_hot in rows if (n >= cut) == is_hot]
    expected = [n for n in served if (low is None or n >= low) and (high is None or n < high)]
    assert Counter(r[0] for r in got.collect()) == Counter(map(at, expected))


@few
@given(
    arrays=st.lists(st.lists(st.text("ab|+é\n'\\", max_size=4), max_size=5), min_size=1, max_size=40),
    delimiter=st.text("ab|+'\\", min_size=1, max_size=3),
)
def test_what_is_encoded_decodes_to_itself(spark, arrays, delimiter):
    df = spark.createDataFrame([(a,) for a in arrays], "a array<string>")
    stored = df.select("a", codec.is_encodable("a", delimiter).alias("ok"), codec.encode_array("a", delimiter, strict=False).alias("t"))
    for row in stored.select("a", "ok", "t", codec.decode_array("t", T.StringType(), delimiter).alias("b")).collect():
        assert row.ok == (row.t is not None)
        assert row.b == (row.a if row.ok else None)
        if not row.ok:
            assert delimiter.join(row.a).split(delimiter) != row.a or row.a == [""]
