"""Registered queries over the test tables, each with the SQL that checks it where SQL can."""

from importlib import import_module

FAMILIES = ("dq", "mq", "bias", "shadow", "explain", "registry", "rollup", "prep", "store", "stream")

QUERIES: dict = {}
ORACLES: dict = {}
for _family in FAMILIES:
    _module = import_module(f"tidewatch.queries.{_family}")
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)
