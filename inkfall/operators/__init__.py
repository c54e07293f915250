"""Execution of typed trees: Spark columns, or Python batches where the tree is too large for one."""
