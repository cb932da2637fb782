"""tracelake: a Spark-first engine for high-rate sensor traces and large text corpora."""
