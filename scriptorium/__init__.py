"""Text-corpus curation, style statistics, retrieval and index maintenance as Spark jobs."""
