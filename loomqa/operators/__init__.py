"""loomqa.operators"""
