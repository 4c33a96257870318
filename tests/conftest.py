import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]

from faultsift.session import configure  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = configure(
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    ).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session
