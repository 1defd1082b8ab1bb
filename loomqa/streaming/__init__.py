"""loomqa.streaming"""
