"""Stages and report tables built from the operators."""
