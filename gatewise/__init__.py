"""gatewise — governance analytics for AI and API traffic on Spark.

Every operator is a plain function ``DataFrame -> DataFrame`` built from
Catalyst expressions, windows and joins.  Sub-packages:

* ``sources``   — table loading, derived views, sinks and table maintenance
* ``functions`` — Column-level building blocks (PII patterns, mask strategies,
                  payload parsers, status codes, pricing)
* ``operators`` — DataFrame operators grouped by domain
* ``plans``     — the registered query catalog and its DuckDB oracle SQL
* ``streaming`` — Structured Streaming drivers over the same operators
"""

__version__ = "0.1.0"
