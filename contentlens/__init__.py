"""Content quality and near-duplicate analytics as Spark DataFrame operators.

Every public operator takes DataFrames (or Columns) and returns DataFrames (or
Columns).  Nothing is collected to the driver except bounded model parameters
(a vocabulary capped by ``max_features``, a trained model).

Layout
------
functions/   Column expressions (text, html, vectors, labels, fixed resources)
operators/   DataFrame-level operators (tf-idf, similarity, stats, model, ...)
sources/     readers / writers with explicit schemas
plans/       end-to-end jobs and the registry of named queries
streaming/   Structured Streaming variant of the page analyser
"""

__version__ = "0.1.0"
