"""Cohorts of biosignal recordings as Spark DataFrames.

``sources``    readers and writers
``functions``  Column -> Column helpers and column-name selection
``operators``  DataFrame -> DataFrame operators
``plans``      multi-step flows, and the operators bound to the TPC-H-like tables
"""
