"""Training-data operators: dedup, secrets, packing, chat, sharding, mixing, search, language ID, HTML.

Nothing outside this package imports it.
"""
