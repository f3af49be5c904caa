"""Operators for preparing training text: near duplicates, filters, mixing, packing, sharding, token files."""
