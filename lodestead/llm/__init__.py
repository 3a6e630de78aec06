"""Training-data operators: sharding, deduplication, filtering, extraction, mixing and tokenisation on Spark."""
