"""Training-data operators: tokens, scoring, filtering, deduplication, mixing and chat formatting."""
