"""The queries without SQL run their operators at production values."""

import inspect

import pytest

from turnwake.operators import hinge
from turnwake.operators.lp import Program
from turnwake.plans import queries as Q

TEST = "/root/testdata/sf0.001"


class Seen(Exception):
    pass


@pytest.mark.parametrize(
    "query, owner, name, least",
    [
        ("lp_allocation", Program, "solve", {"tolerance": 1e-6}),
        ("buffer_frontier", Program, "solve", {"tolerance": 1e-6}),
        ("gbm_scores", hinge, "boosted", {"rounds": 300, "leaves": 63, "least": 200}),
        ("hinge_intervals", hinge, "intervals", {"n_boot": 300}),
    ],
)
def test_production_values(spark, monkeypatch, query, owner, name, least):
    real = inspect.signature(getattr(owner, name))

    def spy(*args, **named):
        bound = real.bind(*args, **named)
        bound.apply_defaults()
        raise Seen({k: bound.arguments[k] for k in least})

    monkeypatch.setattr(owner, name, spy)
    with pytest.raises(Seen) as found:
        Q.UNCHECKED[query](spark, TEST)
    assert found.value.args[0] == least
