"""Set-oriented operators over many cases at once."""
