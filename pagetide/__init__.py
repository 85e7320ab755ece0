"""Keep a web-page corpus fresh with Spark: observe, compare, label, convert, pack."""

import sys

from pyspark import cloudpickle

from pagetide.config import Chunk, Combine, Extract, Markdown, Pack, Refresh, Scope

__all__ = ["Chunk", "Combine", "Extract", "Markdown", "Pack", "Refresh", "Scope"]

# Tasks get the functions of this package by value, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
