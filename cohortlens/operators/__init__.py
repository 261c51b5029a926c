"""Generic DataFrame operators behind the study reports and erasure."""
