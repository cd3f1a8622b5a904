"""Operators on text for training data: packing, leaked evaluation items, sentences. Nothing outside imports this
subpackage."""
