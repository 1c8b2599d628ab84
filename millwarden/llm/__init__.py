"""Training-data operators: filtering, deduplication, tokens, archives and shards.  Nothing outside imports this package."""
