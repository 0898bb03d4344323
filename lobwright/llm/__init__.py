"""Operators that turn raw pages and documents into training data.  Nothing outside this package imports it."""
