"""Training-data operators: thirteen building blocks for cleaning and preparing a text corpus.

Each module holds one operator with its own interface; ``queries`` registers a thin query for each.
Nothing else in the package imports this subpackage.
"""
