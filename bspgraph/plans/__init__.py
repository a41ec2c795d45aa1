"""Vertex programs and the superstep loop that runs them."""
