"""Operators for preparing training data: ten building blocks and the corpus pipeline's queries."""
