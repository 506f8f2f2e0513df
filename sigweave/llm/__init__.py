"""Operators on texts for training corpora: packing, mixing, sentences. Nothing outside this folder imports it."""
