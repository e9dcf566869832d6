"""Part of strandwork."""
