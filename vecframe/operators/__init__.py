"""Operators beyond built-in ones: batch nearest neighbours, upserts, exact lookups."""
