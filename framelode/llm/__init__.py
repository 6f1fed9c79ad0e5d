"""Training-data operators: counting, deduplication, scanning, filtering, mixing and scoring of text corpora."""
