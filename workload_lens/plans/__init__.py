"""Registered queries: the operators over a workload made from the test tables."""
