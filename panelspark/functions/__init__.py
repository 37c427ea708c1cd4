"""Scalar building blocks: Column expressions from Columns."""
