"""utterlake: transcript analytics on Spark (intervals, tokens, segments, sessions, text normalisation)."""
