"""Data operators for language-model corpora; nothing else in the library imports them."""
