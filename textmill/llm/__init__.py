"""Training-data operators: ten corpus-scale text operations as DataFrame functions."""
