"""End-to-end jobs: preflight, build, health and recency analysis."""
