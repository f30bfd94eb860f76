"""Temporal-graph and intrusion analytics as DataFrame-to-DataFrame operators on Spark."""
