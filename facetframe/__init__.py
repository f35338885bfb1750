"""facetframe: faceted catalogue analytics expressed as Spark DataFrame plans.

Every public operator is a function from DataFrames (plus plain parameters) to a
DataFrame. Nothing is collected to the driver inside an operator; Catalyst plans
the whole chain and the cluster runs it.

Layout
------
sources/    table registration, JDBC ingest, type normalisation, Parquet export
functions/  Column-level rules: rounding, cleaning, title case
operators/  DataFrame operators: first/list per key, lookups, filters,
            distributions, people roll-ups, paging, facets, geo metrics,
            place classification, mentions and themes
plans/      assembled pipelines: the wide profile and its two presets
            (film tables and the driver's order tables)
"""

__version__ = "0.1.0"
