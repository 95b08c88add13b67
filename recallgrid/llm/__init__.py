"""Operators for texts and vectors that feed language models; nothing outside this folder imports it."""
