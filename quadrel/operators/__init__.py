"""Operators beyond the select builder: identity, quads, relations, mutations, merging, validation, federation."""
