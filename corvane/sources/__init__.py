"""Reading and writing: files, transcripts, datasets, tables."""
