"""Logical sources: catalogue, files, fixture tables and generated streams."""
