"""From a typed question to a filter and words to search for, and the calls that clients make."""
