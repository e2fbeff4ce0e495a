"""Readers: project folders, uploads, charsets, lenient XML, mapper tags, rename mappings."""
