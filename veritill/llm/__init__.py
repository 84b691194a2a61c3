"""Training-data operators: near duplicates, scoring, quality, mixing, secrets, tokens, HTML, media, toxicity, language."""
