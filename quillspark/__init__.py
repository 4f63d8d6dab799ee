"""A Spark-first analytics engine for document corpora and citation networks."""
