"""Operators for training data: pairs, formatting duplicates, personal data, canonical
values, tokenizer ids, packing and shared spans. Nothing outside imports this package."""
