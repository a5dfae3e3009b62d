"""DataFrame-to-DataFrame operators over indexed bars and moves."""
