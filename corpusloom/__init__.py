"""Text-corpus analytics and retrieval on Spark."""
