"""Part of the content search library."""
