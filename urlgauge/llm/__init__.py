"""Training-data operators: quality, language, perplexity, duplicates, contamination, chat, pieces and search."""
