"""Column builders for outcomes, tolerances, numbers and text."""
