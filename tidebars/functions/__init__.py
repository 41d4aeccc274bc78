"""Part of the bar analytics engine."""
