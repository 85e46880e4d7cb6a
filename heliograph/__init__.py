"""Heliograph: FITS files as Spark data, and operators over them."""
