"""Input tables, stored stages and model tables."""
