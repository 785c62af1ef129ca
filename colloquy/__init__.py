"""DataFrame jobs for conversation corpora on Spark."""
