"""Predicates, aggregates and orderings: nodes that one compiler turns into Spark columns."""
