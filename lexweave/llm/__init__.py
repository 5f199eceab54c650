"""Training-data operators (quality, packing, tokens, media, archives, near-duplicates).

Nothing outside this subpackage imports it; ``queries`` holds the entries that the
driver contract registers when the subpackage is present.
"""
