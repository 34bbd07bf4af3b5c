"""Part of rangeloom."""
