"""Clone analytics over code and text, written for Spark."""
