"""Study presets: the reports and their SQL oracle."""
