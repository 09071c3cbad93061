"""Operators for large-scale text corpora: tokens, licences, duplicates, scores, secrets, chats, packing."""
