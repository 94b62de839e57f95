"""All queries of the library on tables full of nulls and repeated rows, and on empty ones."""

import os
from glob import glob

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from millrace.plans import registry

SMALL = "/root/testdata/sf0.001"

#: Where Spark and the SQL twin define such rows differently, and how; these must still run.
BY_DEFINITION = {
    "base_aggregates": "collected sets leave nulls out",
    "base_arrays_more": "null text: every result is null",
    "base_cosine_to_first": "of rows that repeat the first id, one is the first",
    "base_dialogue": "null turns come first",
    "base_json_and_maps": "null type: no map",
    "base_roundtrip_text": "the text format has no nulls",
    "base_window_frames": "null order keys come first",
    "base_window_functions": "null order keys come first",
    "stream_deduplicated": "null ids are repeats of one another",
    "stream_sessions": "no session without a time",
    "stream_sliding": "no window without a time",
    "stream_tumbling": "no window without a time",
    # Of empty tables.
    "base_cube": "no row for the empty grouping set",
    "base_rollup": "no row for the empty grouping set",
    "cat_hierarchy_rollup": "no row for the empty grouping set",
    "cat_layer_validation": "counts of no rows are 0, not null",
}


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    top = tmp_path_factory.mktemp("tables")
    for kind in ("nulls", "empty"):
        os.makedirs(top / kind)
        for p in glob(f"{SMALL}/*.parquet"):
            t = pq.read_table(p).slice(0, 400 if kind == "nulls" else 0)
            t = pa.concat_tables([t, t.slice(0, 7)])
            r = np.random.default_rng(len(p))
            cols = [pa.array([None if x else v for v, x in zip(t[f.name].to_pylist(), r.random(len(t)) < 0.06, strict=True)], f.type) for f in t.schema]
            pq.write_table(pa.table(cols, schema=t.schema), top / kind / os.path.basename(p))
    return top


@pytest.mark.parametrize("kind", ["nulls", "empty"])
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_nulls_repeats_and_empty_tables(spark, compare, tables, name, kind):
    got = registry.QUERIES[name](spark, str(tables / kind))
    if name in registry.SQL and name not in BY_DEFINITION:
        compare(got, registry.SQL[name], str(tables / kind))
    else:
        got.toPandas()


def test_null_kinds_of_events_are_in_windows(spark, tables):
    events = spark.read.parquet(str(tables / "nulls/events.parquet")).filter("ts is not null")
    got = registry.QUERIES["stream_tumbling"](spark, str(tables / "nulls"))
    assert got.filter("event_type is null").groupBy().sum("n").first()[0] == events.filter("event_type is null").count() > 0
