"""Patient observation tables on Spark: ingest, profile, validate, prepare, split, train, score."""
