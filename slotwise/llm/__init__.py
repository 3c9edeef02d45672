"""Operators for preparing language-model training data (see README.md of the repository, "Training-data operators")."""
