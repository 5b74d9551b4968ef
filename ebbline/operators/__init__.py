"""DataFrame operators of the decomposition."""
