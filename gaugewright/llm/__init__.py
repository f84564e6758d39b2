"""Training-data operators: scoring, archives, fingerprints, mixing, tokens, language, chat and media."""
