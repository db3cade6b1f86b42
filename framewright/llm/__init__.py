"""Training-data operators: dedup, tokenisation, media, chat, quality, mixing.

Nothing outside this subpackage imports it; it may be removed as a whole.
"""
