"""Readers, cleaners and writers for bars, benchmarks, moves and annotations."""
