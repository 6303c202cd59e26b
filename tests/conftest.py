import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pageloom.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[4]",
        **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
           "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "6g"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def pages_of(spark, rows):
    """Pages with their node column from (html, url) pairs, page_id from 0."""
    from pageloom.operators.dom import with_dom

    data = [(i, url, html) for i, (html, url) in enumerate(rows)]
    return with_dom(spark.createDataFrame(data, "page_id bigint, url string, html string"))


def column(df, expression):
    """Values of one expression in page order."""
    return [r[0] for r in df.orderBy("page_id").select(expression).collect()]
