"""Readers and writers: key lines, pairs, binary request logs."""
