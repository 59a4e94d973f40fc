"""Analytics over timed text: spans, words, speaker turns and cues as DataFrames."""
