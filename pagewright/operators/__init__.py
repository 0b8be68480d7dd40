"""Relational operators on detections, blocks and tables."""
