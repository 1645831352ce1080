"""paperloom: literature-graph and ranking analytics as plain DataFrame-to-DataFrame functions."""
