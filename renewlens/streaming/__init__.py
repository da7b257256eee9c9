"""Micro-batch entry points over the same stateless operators."""
