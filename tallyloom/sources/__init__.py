"""Readers and sinks: tables named by a load, workbooks, app files, catalogues."""
