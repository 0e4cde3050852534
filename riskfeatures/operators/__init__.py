"""DataFrame -> DataFrame operators (labels, cutoffs, point-in-time, windows ...)."""
