"""Markup: scanner, layout renderer, tree builder, serializer."""
