"""renewlens: renewal prediction and analysis as Spark jobs.

Layout
------
sources/    table readers, the ``renewal`` view, CSV / JSON-records sources, sinks
functions/  column expressions: level tags, term sort keys, feature recipes
operators/  DataFrame operators: profile, analyses, metrics, split / folds, selection
plans/      MLlib plans: feature pipeline, boosted trees, search, end-to-end jobs
streaming/  Structured Streaming scorer
"""

__version__ = "0.1.0"
