"""loomtext.sources"""
