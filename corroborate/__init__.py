"""Evidence-based fact verification as Spark DataFrame jobs."""
