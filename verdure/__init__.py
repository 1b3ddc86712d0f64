"""Verdure: an expression-compendium analytics engine on PySpark."""
