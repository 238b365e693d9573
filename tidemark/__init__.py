"""A PySpark-native engine for time-ordered event tapes, and for training-data pipelines in ``tidemark.llm``."""
