"""Reading and writing: files with fixed schemas, paged REST series as a Spark data source, archives, artifacts."""
