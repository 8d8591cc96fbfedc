"""Raster-grid analytics on pixel tables, written against the DataFrame API.

A raster is a table with one line per pixel: integer ``row`` and ``col`` plus
one column per band, score or label.  See the README for the operator list.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Tile functions travel inside the plan, so executors need no copy of the package.
register_pickle_by_value(sys.modules[__name__])
