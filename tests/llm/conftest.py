import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def sf():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def frame(spark, rows, schema="doc_id long, text string, lang string, source string, n_chars long, spans string, node int"):
    return spark.createDataFrame(rows, schema)


#: Nulls in any column, empty texts, repeated rows, one long text, and columns whose names clash with the operators' own.
ODD = [
    (1, "", None, "s", 0, "x", 1),
    (2, None, "en", None, None, "x", 1),
    (None, "the cat sat on the mat and the dog ate it all up today", "en", "s", 3, "x", 1),
    (3, "été " * 9000, "fr", "s", 9, None, None),
    (4, "the cat sat on the mat and the dog ate it all up today", "en", "s", 3, "x", 1),
    (4, "the cat sat on the mat and the dog ate it all up today", "en", "s", 3, "x", 1),
    (5, " \n\t ", "en", "s", 3, "x", 1),
]
