"""Whole plans: the OCR pipeline and the registered queries."""
