import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def messages_of(spark):
    """messages(chat_id, ts, seq, text) from (chat_id, second, text)."""

    def build(rows):
        data = [(chat, second, seq, text) for seq, (chat, second, text) in enumerate(rows)]
        raw = spark.createDataFrame(data, "chat_id long, second long, seq long, text string")
        return raw.selectExpr(
            "chat_id",
            "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, second) AS ts",
            "seq",
            "text",
        )

    return build
