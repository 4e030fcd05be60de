"""corpusflow: labelled-text corpus processing on Spark SQL / Structured Streaming / Spark ML.

Public API is ``DataFrame -> DataFrame`` and ``Column -> Column`` functions, grouped as

* ``corpusflow.functions``  scalar Column expressions (cleaning, patterns, vectors, JSON metrics)
* ``corpusflow.sources``    readers and writers (folders, CSV, JSON, Parquet, models)
* ``corpusflow.operators``  relational operators (split, stats, extraction, encoding, evaluation)
* ``corpusflow.models``     trainable classifiers (naive Bayes, centroid, Spark ML linear)
* ``corpusflow.plans``      end-to-end flows (prepare, score) and the registered query catalogue
* ``corpusflow.streaming``  streaming scorers
"""

__version__ = "0.1.0"
