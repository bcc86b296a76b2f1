"""rinkframe: a Spark-first engine for paginated curling result books and text corpora."""
