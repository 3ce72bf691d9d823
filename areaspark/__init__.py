"""Small-area community indicators as composable Spark DataFrame transforms.

Sub-packages
------------
``functions``  Column expressions (missing-value rules, text, numbers, dates).
``sources``    schemas, readers and sinks.
``operators``  general DataFrame -> DataFrame transforms (joins, reshaping,
               windows without hot groups, spatial join, benchmarks).
``plans``      the indicator pipelines built from the operators.
``queries``    the registered queries over the driver tables.
"""
