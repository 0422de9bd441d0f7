"""Readers and writers of corpora, programs, embeddings, labels and configuration."""
