import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from newsburst.schemas import ARTICLES, CONFIGS, LINKS
from newsburst.session import build_session

AS_OF = dt.datetime(2024, 5, 1, 12, 0, 0)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        master="local[8]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture
def make(spark):
    """Small article, link, tenant and config tables from the columns a test cares about."""

    class Make:
        as_of = AS_OF

        def articles(self, rows):
            base = {
                "system_id": 1, "is_shared": False, "title": "t", "summary": None, "full_text": None,
                "weight": 1, "source": "s", "attr": None, "embedding": None, "is_deleted": False,
                "create_time": AS_OF,
            }
            filled = [{**base, **row} for row in rows]
            from decimal import Decimal

            data = [
                tuple(
                    Decimal(str(r[f.name])) if f.name == "weight" and r[f.name] is not None else r[f.name]
                    for f in ARTICLES.fields
                )
                for r in filled
            ]
            return spark.createDataFrame(data, ARTICLES)

        def links(self, pairs):
            return spark.createDataFrame(pairs, LINKS)

        def systems(self, *ids, inactive=()):
            rows = [(i, f"code{i}", f"name{i}", i not in inactive) for i in ids]
            return spark.createDataFrame(
                rows, "system_id BIGINT, system_code STRING, system_name STRING, is_active BOOLEAN"
            )

        def configs(self, *rows):
            """(system_id, hours, eps, min_samples, cap, snapshot_limit)"""
            data = [(i, h, e, m, "", "", cap, k) for i, h, e, m, cap, k in rows]
            return spark.createDataFrame(data, CONFIGS)

    return Make()
