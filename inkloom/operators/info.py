"""State of the engine and of a backend as rows."""

from __future__ import annotations

import importlib.util
import sys

from pyspark.sql import DataFrame, SparkSession

from inkloom.operators.backend import Backend


def engine_info(spark: SparkSession, backend: Backend | None = None) -> DataFrame:
    """label, detail, ok, blocking."""
    rows = [
        ("python", sys.version.split()[0], sys.version_info >= (3, 11), True),
        ("spark", spark.version, int(spark.version.split(".")[0]) >= 4, True),
    ]
    rows += [(name, "present" if importlib.util.find_spec(name) else "absent", importlib.util.find_spec(name) is not None, name == "pandas") for name in ("pandas", "pyarrow")]
    if backend is not None:
        rows.append(("backend", backend.name, backend.is_available(), False))
    return spark.createDataFrame(rows, "label string, detail string, ok boolean, blocking boolean")
