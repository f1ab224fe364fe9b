"""Generation-provenance analytics and corpus preparation, written for Spark."""
