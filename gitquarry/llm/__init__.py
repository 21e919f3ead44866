"""Operators for preparing text corpora for model training.

Each module holds one operator over DataFrames: near-duplicate and exact
de-duplication, substring de-duplication, decontamination, packing, web
archives, url, toxicity, personal-data and licence scans.  ``queries`` binds
them to the tables of a folder; nothing outside this package imports it.
"""
