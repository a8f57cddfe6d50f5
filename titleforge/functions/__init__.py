"""Scalar functions: Column to Column, with pandas functions where SQL has no form."""
