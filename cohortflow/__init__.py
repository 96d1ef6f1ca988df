"""cohortflow: cohort risk analytics as Spark DataFrame operators.

Every public operator takes DataFrames (plus plain Python parameters) and
returns a DataFrame; nothing is collected to the driver except schema-sized
metadata (column lists, small parameter tables).  Sub-packages:

* ``sources``   - readers/writers, sentinel cleaning, header hygiene, schema helpers
* ``functions`` - pure Column-expression builders (rule algebra, logit, tiers)
* ``operators`` - profiling, metrics, calibration, preprocessing, models, search,
                  stability selection, scoring, post-prediction analytics, explanations
* ``plans``     - deterministic stand-in views over the driver tables and the
                  registry of named queries used by the entry point
* ``streaming`` - stateless scoring of a streaming DataFrame with fitted models
"""

__version__ = "0.1.0"
