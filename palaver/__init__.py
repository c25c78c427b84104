"""Dialogue analytics on Spark: transcripts, revocable hypotheses, tags, language models, decoding and evaluation."""

from __future__ import annotations

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with their code, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
