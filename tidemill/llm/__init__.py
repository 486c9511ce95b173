"""Training-data operators: scoring, rules, dedup, decontamination, packing.

Nothing outside this subpackage imports it.  Every operator module has a
general function on DataFrames; the thin ``opN_*`` queries are in
:mod:`tidemill.llm.queries`.
"""
