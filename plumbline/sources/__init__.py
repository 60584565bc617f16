"""Where sites and files come from: bindings of the star and text tables, and scans of trees of files."""
