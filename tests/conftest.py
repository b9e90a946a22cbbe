import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


FLOW = "event_id long, src_port long, dst_port long, protocol string, packet_count long, conn_state string, " \
       "bytes_transferred double, timestamp long, attack long"


@pytest.fixture
def flows(spark):
    """Build a flow table from short rows; unspecified columns get ordinary values."""

    def build(*rows: dict):
        base = {"src_port": 2000, "dst_port": 443, "protocol": "TCP", "packet_count": 10, "conn_state": "EST",
                "bytes_transferred": 100.0, "timestamp": 1_700_000_000, "attack": 0}
        full = [{"event_id": i} | base | row for i, row in enumerate(rows)]
        names = [c.strip().split()[0] for c in FLOW.split(",")]
        return spark.createDataFrame([tuple(r[n] for n in names) for r in full], FLOW)

    return build


def rows_of(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]
