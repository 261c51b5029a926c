"""Table scans, id lists, study fixtures, CSV export and snapshots."""
