from __future__ import annotations

import pathlib
import sys

import pytest
from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, str(pathlib.Path(__file__).parents[1]))


@pytest.fixture(scope="session")
def spark() -> SparkSession:
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def units(spark):
    """Units from `{path: text}`; the language comes from the suffix."""
    languages = {"py": "python", "java": "java", "js": "javascript"}

    def make(texts: dict[str, str]) -> DataFrame:
        rows = [(path, languages[path.rsplit(".", 1)[1]], text) for path, text in texts.items()]
        return spark.createDataFrame(rows, "path string, language string, content string")

    return make
