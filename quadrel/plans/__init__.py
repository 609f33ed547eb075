"""Query plans and the fluent builder."""
