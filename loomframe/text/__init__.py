"""Tokenizers, BPE training, token shards, packing and mixtures."""
