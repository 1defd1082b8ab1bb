"""loomqa.functions"""
