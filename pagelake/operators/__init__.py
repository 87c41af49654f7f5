"""Operators: OCR, budget, storage, evaluation, reports."""
