"""Whole comparisons, composed of operators, and the sample tables the registered queries read."""
