"""shoplens: web-shop clickstream analytics on Spark.

Layers (all DataFrame in, DataFrame out; nothing is collected in the core):

* ``sources``   - bronze table scan/write, bridges from the driver tables, envelopes,
                  geo networks, pixel change feed
* ``functions`` - column expressions (price parsing, rates, geo labels, IP text) and
                  driver-side period arithmetic
* ``operators`` - reusable relational building blocks (orphan guard, two-step distinct,
                  calendar densify, top-k, range join, sessionize, batch validation)
* ``plans``     - silver/gold views and the report functions
* ``streaming`` - Structured Streaming ingest, windowed counts, incremental refresh
"""

__version__ = "0.1.0"
