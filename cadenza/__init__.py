"""Cadenza: a Spark-native engine for listening-event histories.

Raw pages -> canonical events -> marts -> enriched marts, every step a DataFrame plan.
"""

__version__ = "0.1.0"
