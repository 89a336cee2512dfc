"""Scalar and column functions: geometry codecs, predicates, value comparison."""
