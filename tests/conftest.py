import os
import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pyspark.sql import SparkSession  # noqa: E402

from gristmill import Spec, configure  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="run-", dir="/tmp"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def spec():
    """A harbour: berths and cargo, a length rule and a comparison, and one example pair."""
    cargo = {"tons": 12.5, "kind": "ore", "sealed": True, "ports": ["Aal", "Bo"]}
    piers, kinds = ["north", "south", "east"], ["grain", "ore", "oil", "timber", "mixed"]
    return Spec.from_dict(
        {
            "name": "harbour",
            "entities": {
                "Berth": {
                    "fields": {
                        "number": {"type": "int", "range": [1, 60]},
                        "pier": {"type": "string", "enum": piers},
                        "crane": "bool",
                        "remark": {"type": "string", "required": False},
                    }
                },
                "Cargo": {
                    "fields": {
                        "tons": {"type": "float", "range": [0.5, 40.0]},
                        "kind": {"type": "string", "enum": kinds},
                        "sealed": "bool",
                        "ports": {"type": "list[string]", "required": False},
                    }
                },
            },
            "constraints": [
                {"expr": "len(pier) >= 5", "message": "long piers only"},
                {"expr": "tons < 35", "message": "needs the big crane", "severity": "warning"},
            ],
            "examples": [{"input": {"note": "ore, sealed"}, "output": cargo | {"type": "Cargo"}}],
        }
    )


@pytest.fixture
def records(spark):
    """JSON texts as a table ``n, raw, fields``."""
    from gristmill.operators.records import with_record

    def make(texts):
        return with_record(spark.createDataFrame(list(enumerate(texts)), "n int, raw string"))

    return make


@pytest.fixture
def answers():
    """Values of one Column, in row order."""

    def collect(df, column, order="n"):
        return [r[0] for r in df.select(column.alias("x"), order).orderBy(order).select("x").collect()]

    return collect
