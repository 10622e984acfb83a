"""Operators for large text corpora: cleaning, matching, scoring, packing and binary output."""
