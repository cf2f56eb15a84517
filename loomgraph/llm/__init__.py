"""Training-data operators: media, packing, near-duplicates, scoring, PII, secrets, rules, mixing, chat."""
