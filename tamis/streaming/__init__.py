"""Streams: an extension, for intake that arrives continuously."""
