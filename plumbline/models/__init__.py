"""Estimators: ``fit`` takes a frame with number columns and a label column, ``predict`` adds ``prediction``."""
