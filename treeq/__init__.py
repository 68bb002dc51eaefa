"""treeq: query, check, compare and edit dependency-annotated text as Spark DataFrames.

A sentence is one row; its tokens are an array of structs, sorted by id and numbered from 1, so a head is
`get(words, head - 1)` and everything inside a sentence runs without a shuffle.
"""
