"""Files: Hadoop paths, CSV import and export."""
