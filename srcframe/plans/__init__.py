"""Whole jobs composed from the operators: scan, pack, distill and audit."""
