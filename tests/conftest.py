import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from compare import session

    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()


@pytest.fixture
def evaluate(spark):
    """evaluate(function, inputs): the column function's value for each input tuple."""
    from pyspark.sql import functions as F

    def run(function, inputs):
        width = max(len(i) for i in inputs)
        schema = "i int, " + ", ".join(f"c{n} string" for n in range(width))
        df = spark.createDataFrame([(n, *i) for n, i in enumerate(inputs)], schema)
        out = df.select("i", function(*[F.col(f"c{n}") for n in range(width)]).alias("out"))
        return [row.out for row in out.orderBy("i").collect()]

    return run
