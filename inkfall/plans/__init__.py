"""From template text to a typed tree: types, front matter, syntax, analysis."""
