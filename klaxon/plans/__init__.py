"""Compositions of operators: service answers, the payload, the report."""
