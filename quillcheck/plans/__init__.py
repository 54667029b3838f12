"""Rulesets and the registered queries built on the operators."""
