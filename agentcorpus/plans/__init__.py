"""Compositions of the operators: inventory, ladder, evaluation and dashboards."""
