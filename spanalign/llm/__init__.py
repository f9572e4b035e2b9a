"""Training-data operators: packing, BPE, near-duplicates, secrets, quality and so on.

Nothing outside this folder imports it; the folder can be deleted as a whole.
"""
