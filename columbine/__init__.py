"""columbine: column-level data-flow analytics as Spark DataFrame jobs.

Every operator takes DataFrames and returns DataFrames; the work runs as
joins, windows, aggregations and built-in column expressions so Catalyst
can prune, push down and pick join strategies.

Sub-packages:

* ``functions``  Column -> Column text helpers (normalization, regex rules)
* ``sources``    readers, writers and the derived test fixtures
* ``operators``  relational operators (delta, graph, resolution, reports)
* ``plans``      the named queries registered for the driver
* ``streaming``  incremental (availableNow) front end for SQL corpora
"""

__version__ = "0.1.0"
