"""Models and readers that come from outside, behind small interfaces."""
