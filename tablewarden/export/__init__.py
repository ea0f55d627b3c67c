"""Contracts in other tools' formats, and back."""
