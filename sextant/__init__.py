"""Evidence-based ranking and its evaluation as DataFrame operators on Spark."""
