import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
DATA = os.environ.get("TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    from docketlens.session import ship

    ship(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    return DATA


COMMENTS = (
    "document_number string, comment_id string, comment_text string, posted_date string, receive_date string, postmark_date string, first_name string, last_name string, organization string, submitter_type string, city string, "
    "state_province_region string, country string, zip string, gov_agency string, gov_agency_type string, has_attachments boolean, attachment_count long, attachment_formats string, attachment_text string, duplicate_comments long, page_count long"
)


@pytest.fixture
def comments(spark):
    """Builds a comments table from dicts; missing columns are NULL, extra ones are added as text."""

    def build(rows, extra=()):
        names = [c.split()[0] for c in COMMENTS.split(", ")]
        schema = COMMENTS + "".join(f", {c} string" for c in extra)
        return spark.createDataFrame([tuple(r.get(n) for n in [*names, *extra]) for r in rows], schema)

    return build


#: Columns that operators use inside; an input that has them must not disturb.
CLASHING = ("h", "sk", "token", "n", "kind", "row", "score", "value", "rank", "field", "g", "block", "_salt", "words")
