"""aulamill: a Spark-first engine for banks of quiz questions.

Sub-packages: ``sources`` (readers), ``functions`` (column expressions),
``operators`` (DataFrame operators), ``plans`` (reports, plans of file changes
and the driver's query catalog), ``streaming`` (incremental ingest) and the
optional ``llm`` (training-data operators, imported by nothing else here).
"""
