"""loomqa.sources"""
