import random
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pitstore.functions import expr
from pitstore.model import SchemaError
from pitstore.operators import revise

ev = lambda text, payload, history=(): expr.evaluate(expr.parse(text), payload, list(history))


def test_values():
    assert ev("a - b", {"a": "0.3", "b": "0.2"}) == Decimal("0.1")
    assert ev("1/0", {}) is None
    assert ev("actual + forecast * 2", {"actual": 1, "forecast": "2"}) == 5
    assert ev("-(a - b)", {"a": "0.3", "b": "0.2"}) == Decimal("-0.1")
    assert ev("a * a", {"a": "1e500000"}) is None
    assert ev("a + b", {"a": 1, "b": None}) is None and ev("a", {"a": True}) is None
    assert ev("since(at)", {"at": 1000, "known_at": 1500}) == 500 and ev("until(at)", {"at": 2000, "known_at": 1500}) == 500


def test_windows():
    h = [{"x": v} for v in ("1", "2")]
    assert ev("lag(x, 1)", {"x": "3"}, h) == 2 and ev("lag(x, 0)", {"x": "3"}, h) is None and ev("lag(x, 3)", {"x": "3"}, h) is None
    assert ev("diff(x, 1)", {"x": "3"}, h) == 1 and ev("diff(x, 2)", {"x": "3"}, h[:1]) is None
    assert ev("pct_rank(x, window=4)", {"x": "3"}, [{"x": str(k)} for k in range(1, 5)]) == Decimal("0.5")
    z = [{"x": v} for v in ("0", "0", "0", "1", "-1")]
    assert ev("zscore(x, min_obs=4, window=5)", {"x": "2"}, z) is not None
    assert ev("zscore(x, window=5, min_obs=4)", {"x": "2"}, z[:2]) is None
    assert ev("zscore(x, window=5, min_obs=2)", {"x": "2"}, [{"x": "1"}, {"x": None}, {"x": "3"}]) is None
    assert ev("zscore(x, window=5, min_obs=2)", {"x": "2"}, [{"x": "1"}] * 4) is None


@pytest.mark.parametrize("text", ["", "a +", "foo(a)", "lag(a)", "lag(a + b, 1)", "lag(a, 1.5)", "zscore(a, window=3)", "zscore(a, window=3, window=4)", "pct_rank(a, n=3)", "a b", "lag", "a $ b", "(a"])
def test_refused(text):
    with pytest.raises(SchemaError):
        expr.parse(text)


def test_analysis():
    assert expr.lookback("lag(a, 3) + zscore(b, window=24, min_obs=2)") == 24
    assert expr.lookback("pct_rank(a, window=10)") == 10 and expr.lookback("since(a)") == 0
    assert expr.referenced_names("a + lag(b, 2) * -c") == {"a", "b", "c"}


@settings(max_examples=50, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(-50, 50)), max_size=40), st.integers(0, 12))
def test_a_limited_history_is_the_tail_of_the_full_one(values, n):
    history = [{"x": v} for v in values]
    for text in (f"lag(x, {n})", f"zscore(x, window={n}, min_obs=2)", f"pct_rank(x, window={n})"):
        depth = expr.lookback(text)
        assert ev(text, {"x": 3}, history) == ev(text, {"x": 3}, history[-depth:] if depth else [])


def test_columns_agree_with_the_exact_values(spark):
    rng = random.Random(5)
    rows = [(s, k, Decimal(rng.randint(-500, 500)) / 100 if rng.random() > 0.05 else None) for s in "ab" for k in range(60)]
    df = spark.createDataFrame(rows, "scope string, k int, x decimal(19,8)")
    texts = {"l": "lag(x, 2)", "d": "diff(x, 1)", "z": "zscore(x, window=6, min_obs=3)", "p": "pct_rank(x, window=5)", "q": "x / lag(x, 1)"}
    out = df
    for name, text in texts.items():
        out = revise.with_derived(out, [(name, text)], ["scope"], ["k"])
    got = {(r["scope"], r["k"]): r for r in out.collect()}
    for s in "ab":
        mine = [(k, x) for t, k, x in rows if t == s]
        for k, x in mine:
            history = [{"x": v} for j, v in mine if j < k]
            for name, text in texts.items():
                want, have = ev(text, {"x": x}, history), got[s, k][name]
                assert (want is None) == (have is None), (s, k, name, want, have)
                assert want is None or abs(float(want) - float(have)) < 1e-6
