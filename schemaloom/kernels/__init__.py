"""Pure-Python kernels for the recursive grammars: no Spark in here."""
