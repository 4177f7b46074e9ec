"""upkeep: predictive-maintenance analytics expressed as Spark DataFrame plans.

Layout
------
sources/    landing of the maintenance tables (fixture derivation), CSV readers, sinks
functions/  Column expressions (text cleanup, dates, keyed random numbers, tagged records)
operators/  relational building blocks (rollups, skew-safe windows and splits, encoders,
            profiles, TF-IDF, sampling, evaluation)
plans/      composed queries: interval labels, lifespan features, tickets, corpus jobs,
            reports, models; ``plans.registry`` lists every query by name
streaming/  incremental append/resume of corpus rows with Structured Streaming
oracle/     DuckDB SQL used as an independent check of every deterministic query
"""

__version__ = "0.1.0"
