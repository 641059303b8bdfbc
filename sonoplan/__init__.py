"""Audit, sampling, splitting and evaluation of labelled recording datasets as Spark plans."""
