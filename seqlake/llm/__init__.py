"""Training-data operators: ten jobs over documents, pages and embeddings, and their queries.

Nothing else in the library imports this subpackage.
"""
