"""Readers, generators, tables and range bookkeeping."""
