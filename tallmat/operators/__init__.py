"""DataFrame-to-DataFrame operators on tall count matrices."""
