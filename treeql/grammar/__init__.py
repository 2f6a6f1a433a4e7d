"""Grammars: rules, their compiler to LR tables, and the parser."""
