"""All queries of the library outside the training-data subpackage: name -> callable and name -> SQL."""

from __future__ import annotations

from millrace.functions import scalars, udfs
from millrace.operators import catalogue, contamination, relational
from millrace.sources import roundtrip
from millrace.streaming import events

QUERIES: dict = {}
SQL: dict = {}
for _module in (relational, contamination, scalars, catalogue, roundtrip, events, udfs):
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
