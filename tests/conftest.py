import os
import sys
from datetime import date, datetime

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lamina.session import start  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = start(
        "local[4]",
        "tests",
        spark_sql_shuffle_partitions="4",
        spark_ui_enabled="false",
        spark_driver_memory="4g",
        spark_checkpoint_dir=str(tmp_path_factory.mktemp("shared")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def at(text):
    """'08-28 12:00' in 2026."""
    return datetime.strptime(f"2026-{text}", "%Y-%m-%d %H:%M")


def day(text):
    return date(2026, *map(int, text.split("-")))


def rows(df, *columns):
    """Rows as sorted tuples."""
    chosen = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in chosen.collect()), key=lambda r: tuple(str(v) for v in r))
