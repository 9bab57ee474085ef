"""evidencia: evidence analytics over already collected public-source tables, as DataFrame stages."""

__version__ = "0.1.0"
