"""Search over pipelines, algorithms and their parameters."""
