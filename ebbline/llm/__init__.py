"""Operators for text corpora: filtering, matching, cleaning and tokenising documents."""
