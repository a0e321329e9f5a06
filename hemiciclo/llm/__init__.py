"""Operators that prepare text for training corpora; nothing outside this folder imports them."""
