"""Part of pressmill."""
