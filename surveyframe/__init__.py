"""Survey analytics on Spark: answers in, counted and audited results out."""
