"""Training-data operators: near-duplicates, tokens, rules, shards, contamination, secrets, toxicity, whitening, manifests."""
