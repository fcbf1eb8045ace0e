"""Operators for preparing text corpora; nothing else in cueflow imports this subpackage."""
