"""casemill: a Spark-first engine for messy report data and item-pair signals."""
