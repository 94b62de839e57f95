import datetime
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def rows_of(frame):
    """A pandas frame as sorted plain rows: nulls alike, floats rounded, columns by name."""
    import numpy as np
    import pandas as pd

    def plain(v):
        if v is np.ma.masked:
            return None
        if isinstance(v, (list, tuple, np.ndarray)):
            return tuple(plain(x) for x in v)
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return None
        if isinstance(v, datetime.date):
            return str(pd.Timestamp(v))
        if isinstance(v, (bool, np.bool_)):
            return bool(v)
        if isinstance(v, (int, float, np.integer, np.floating)):
            return round(float(v), 6)
        return v

    cols = sorted(frame.columns)
    return sorted((tuple(plain(v) for v in r) for r in frame[cols].itertuples(index=False, name=None)), key=repr)


@pytest.fixture(scope="session")
def compare():
    import os
    from glob import glob

    import duckdb

    def run(df, sql, d):
        c = duckdb.connect()
        for p in glob(f"{d}/*.parquet"):
            c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
        mine, theirs = df.toPandas(), c.execute(sql).df()
        assert sorted(mine.columns) == sorted(theirs.columns)
        assert rows_of(mine) == rows_of(theirs)
        return mine

    return run
