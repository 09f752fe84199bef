"""The keyed document store, the index catalog and the search index over both."""
