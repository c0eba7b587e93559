"""The Spark session used by tests."""

import tempfile

from pyspark.sql import SparkSession


def session(master: str = "local[8]", partitions: int = 8) -> SparkSession:
    spark = (SparkSession.builder.master(master).appName("flowsieve-tests")
             .config("spark.sql.shuffle.partitions", str(partitions))
             .config("spark.driver.memory", "12g")
             .config("spark.ui.enabled", "false")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="flowsieve-tests-"))
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark
