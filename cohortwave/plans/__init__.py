"""Multi-step flows, and the operators bound to the TPC-H-like tables."""
