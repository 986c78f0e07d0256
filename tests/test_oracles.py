"""Every registered query against its oracle on the smallest tables; those without one must run."""

from __future__ import annotations

import math

import pandas as pd
import pytest

from litgraph import registry

from .conftest import SF

registry.load()


def rows(frame: pd.DataFrame) -> list:
    frame = frame[sorted(frame.columns)]

    def one(x):
        if hasattr(x, "tolist") and not isinstance(x, str):
            x = x.tolist()
        if x is None or x is pd.NA or isinstance(x, float) and math.isnan(x):
            return None
        if isinstance(x, (bool, list)):
            return str(x)
        try:
            return f"{float(x):.6f}"
        except (TypeError, ValueError):
            return str(x)

    return sorted(map(str, (tuple(one(x) for x in r) for r in frame.astype(object).itertuples(index=False))))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(name, spark, duck):
    got = registry.QUERIES[name](spark, SF).toPandas()
    if name not in registry.ORACLES:
        assert len(got)
        return
    want = duck.execute(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
