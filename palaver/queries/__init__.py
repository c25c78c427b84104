"""Registered queries of the dialogue engine: name -> Spark callable, name -> DuckDB SQL."""

from __future__ import annotations

from . import corpus, files, hypotheses, live, markup, modelling, ordered, scoring, tagging

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (tagging, ordered, scoring, modelling, live, corpus, files, hypotheses, markup):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
