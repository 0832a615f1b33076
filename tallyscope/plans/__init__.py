"""Multi-step analyses assembled from the operators."""
