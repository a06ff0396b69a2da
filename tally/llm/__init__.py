"""Training-data operators: formatting, deduplication, decontamination, quality, mixing.

One module per operator. ``queries`` registers one query per operator and
``oracle`` holds the SQL of those that SQL can express. Nothing else in the
library imports this subpackage.
"""
