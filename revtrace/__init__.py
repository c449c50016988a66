"""revtrace: follow a scientific claim from a preprint's first version to its published paper, and find later papers
that still rely on a revised value. Every operator takes DataFrames and returns DataFrames."""
