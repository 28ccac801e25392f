"""DataFrame steps the lists are composed of."""
