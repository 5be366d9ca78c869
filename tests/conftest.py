import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from quire.plans.registry import ship  # noqa: E402
from quire.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session("8", "quire-tests")
    ship(s)
    yield s


@pytest.fixture
def ask(spark):
    """Evaluate one column expression on one row of values."""
    def run(make, **values):
        schema = ", ".join(f"{k} {_type(v)}" for k, v in values.items())
        df = spark.createDataFrame([tuple(values.values())], schema)
        return df.select(make(*[df[k] for k in values]).alias("r")).first()[0]

    return run


def _type(v):
    if isinstance(v, list):
        return "array<string>"
    return {str: "string", int: "bigint", float: "double", bool: "boolean", bytes: "binary"}[type(v)]
