"""The queries of the library's own operators."""
