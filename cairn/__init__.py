"""Place retrieval, walk building and their measurement as Spark jobs."""
