"""Statistics that reduce one dimension of a grid."""

from tidewell.operators import aggregations, directional, distribution, exceedance, extremes, probability, spectral, windpower

__all__ = ["aggregations", "directional", "distribution", "exceedance", "extremes", "probability", "spectral", "windpower"]
