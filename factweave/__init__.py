"""Dated, sourced fact analytics on PySpark."""
