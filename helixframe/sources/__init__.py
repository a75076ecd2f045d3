"""Readers and writers of the file formats that genomic tables come in."""
