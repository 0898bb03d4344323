"""Relational operators over snapshot, trade and result tables."""
