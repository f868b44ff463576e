"""Whole analyses built from the operators, with their fitted models."""
