"""Functions of the region, text, sequence and state planes."""
