"""Training-data operators: ten corpus operations that the rest of the library never imports."""
