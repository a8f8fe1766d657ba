"""Training-data operators: quality, near/exact dedup, secrets, PII, BPE, packing.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries
only when it is present.
"""
