"""Training-data operators: language ID, binary token output, line, document and passage dedup, secret scans, exact
top-k search, token counts, packing and benchmark decontamination. Nothing outside this subpackage imports it.
"""
