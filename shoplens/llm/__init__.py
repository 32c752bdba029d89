"""Operators that prepare text corpora, conversations and embeddings for training. Nothing else in the library imports them."""
