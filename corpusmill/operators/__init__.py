"""Operators over records, assessments and labels."""
