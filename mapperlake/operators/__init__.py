"""Relational operators over mapper metadata: symbols, references, rendering, facts, lineage, renames, conversion."""
