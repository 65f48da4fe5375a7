"""Spark-native curation, routing and evaluation of labelled text corpora.

Every operator is a function from DataFrame to DataFrame.  Lexicons, label
spaces, thresholds, bands and models are arguments or tables, never globals.
"""

from labelmill.config import AGRONOMY, AGRONOMY_EVAL, LabelSpec, RuleConfig

__all__ = ["AGRONOMY", "AGRONOMY_EVAL", "LabelSpec", "RuleConfig"]
