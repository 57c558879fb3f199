"""Micro-batch execution of the batch operators.

The reference has no streaming operator (no watermark, window or state);
nothing new is computed here. ``incremental`` runs a point-in-time feature
operator over evaluation rows that arrive as a stream, with the same
results as the batch query on all rows.
"""
