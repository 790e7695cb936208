"""DataFrame operators for public-procurement analytics, and for training-data pipelines in `llm`."""
