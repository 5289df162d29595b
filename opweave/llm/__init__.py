"""Operators over training text: packing into containers, leaked test passages, abusive content."""
