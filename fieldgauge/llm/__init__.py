"""Operators for preparing training data, each over a whole table of documents or vectors."""
