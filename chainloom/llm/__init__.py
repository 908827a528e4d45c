"""Operators for preparing language-model training data, as Spark jobs over documents,
pages and embeddings.  Nothing else in the library imports this subpackage."""
