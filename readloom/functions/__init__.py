"""Part of readloom."""
