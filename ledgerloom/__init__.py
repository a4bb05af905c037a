"""Statement extraction and reconciliation as Spark jobs, with operators for large text corpora."""
