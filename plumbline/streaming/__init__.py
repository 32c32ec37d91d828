"""Fitted operators on streams."""
