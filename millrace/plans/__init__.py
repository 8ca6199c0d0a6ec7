"""Inspection of physical plans and of how well a layout prunes."""
