"""Training-data operators over whole corpora; nothing else in the package imports this."""
