"""Adapters that bring outside data into the bar schema."""
